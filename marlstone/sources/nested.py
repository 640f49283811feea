"""Records anywhere in nested JSON, as VARIANT columns opened a level at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.staging import stage_table


def _is(value: str, kind: str) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def walk(df: DataFrame, ident: str, data: str) -> DataFrame:
    """``ident, path, parent, within, key, value``: every member of every object and list in the JSON text ``data``.

    ``path`` holds the places from the root on, ``parent`` the key under which the object or list stands and ``within`` whether it is
    a list. Members of an object come by key. A text that is null or no JSON has none. Each level is a table of its own,
    written, since the next is made of it; their number is the depth of the deepest text.
    """
    spark = df.sparkSession
    root = df.select(F.col(ident).alias("_id"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json(data).alias("value"))
    level, found = root.where("value is not null"), None
    while True:
        opened = spark.sql(
            "select l._id, array_append(l.path, e.pos) as path, l.key as parent, startswith(schema_of_variant(l.value), 'ARRAY') as within, e.key, to_json(e.value) as text from {level} as l, lateral variant_explode(l.value) as e",
            level=level,
        )
        # as text between levels
        members = stage_table(opened, "level")
        level = members.select("_id", "path", "parent", "within", "key", F.parse_json("text").alias("value"))
        found = level if found is None else found.unionByName(level)
        if members.isEmpty():
            return found.withColumnRenamed("_id", ident)


def _texts(value: str) -> Column:
    """An object as a map: strings as they are, anything else as JSON, null as null."""
    return F.expr(f"transform_values(cast({value} as map<string, variant>), (k, v) -> case when is_variant_null(v) then null when schema_of_variant(v) = 'STRING' then variant_get(v, '$', 'string') else to_json(v) end)")


def nested_rows(df: DataFrame, ident: str, data: str, targets: Sequence[str]) -> DataFrame:
    """``ident, path, key, row``: the records under keys that match a target (``key_matches``) anywhere in nested JSON, an object or the objects of a list; by ``path`` outer ones stand before those inside them."""
    members = walk(df, ident, data)

    def named(c: str) -> Column:
        out = F.lit(False)
        for t in targets:
            out = out | T.key_matches(F.col(c), t)
        return F.coalesce(out, F.lit(False))

    under = F.when(F.col("within"), F.col("parent")).otherwise(F.col("key"))
    kept = members.where(_is("value", "OBJECT")).where(F.when(F.col("within"), named("parent")).otherwise(named("key")))
    return kept.select(ident, "path", under.alias("key"), _texts("value").alias("row"))
