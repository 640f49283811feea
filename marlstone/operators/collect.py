"""Records of one material brought together, in the order of a document.

A record joins the first known material of its document that it is, else it is a new one. It is
a known material if that one's name, or its symbol, is its own name or symbol; different formulas from
one kind of source forbid the link by name. A material that takes a record in may change its
name, symbol and formula, and with these what it takes in later.

So order decides, but only among records that names and symbols connect: components of
these are found first, on tables, and each is gone through in order by itself, with an index of
names, while it streams through a task. A large document is many components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.graph import connected_components
from marlstone.staging import stage_table

#: The kind of source whose formulas do not replace a known one.
SYNTHESIS = "synthesis condition"
_SEEN = "doc string, ord long, material long, name string, symbol string, formula string, source string"


class Materials:
    """Materials of one component, in order of their first records, found by name or symbol."""

    def __init__(self) -> None:
        self.known: list[dict] = []
        self.named: dict[str, set[int]] = {}

    def place(self, record: dict) -> dict:
        """The material that takes the record in, as it is afterwards."""
        near = {k for ident in (record["name"], record["symbol"]) if ident for k in self.named.get(ident, ())}
        hit = next((k for k in sorted(near) if self._is(self.known[k], record)), None)
        if hit is None:
            hit = len(self.known)
            self.known.append({**record, "material": record["ord"]})
        else:
            self._take(self.known[hit], record)
        for ident in (self.known[hit]["name"], self.known[hit]["symbol"]):
            if ident:
                self.named.setdefault(ident, set()).add(hit)
        return self.known[hit]

    @staticmethod
    def _is(known: dict, record: dict) -> bool:
        own = (record["name"], record["symbol"])
        if known["name"] and known["name"] in own:
            return known["formula"] == record["formula"] or known["source"] != record["source"]
        return bool(known["symbol"]) and known["symbol"] in own

    @staticmethod
    def _take(known: dict, record: dict) -> None:
        if known["name"] and known["name"] == record["symbol"]:
            known["name"], known["symbol"] = record["name"] or known["name"], record["symbol"]
        if (record["general"] and record["source"] != SYNTHESIS) or not known["formula"]:
            known["formula"], known["source"] = record["formula"], record["source"]
        known["name"], known["symbol"] = known["name"] or record["name"], known["symbol"] or record["symbol"]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``doc, component, ord, name, symbol, formula, source, general`` in the order of the first three."""
    now, materials = None, Materials()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if (row["doc"], row["component"]) != now:
                now, materials = (row["doc"], row["component"]), Materials()
            at = materials.place(row)
            out.append({"doc": row["doc"], "ord": row["ord"], **{c: at[c] for c in ("material", "name", "symbol", "formula", "source")}})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("doc", pa.string()), ("ord", pa.int64()), ("material", pa.int64()), *((c, pa.string()) for c in ("name", "symbol", "formula", "source"))]))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``doc, material, base, ord, pos, key, value`` in the order of the first five: a key that its material has already gets the least free number."""
    now, used, last = None, set(), {}
    for batch in batches:
        names = []
        for doc, material, base, key in zip(*(batch.column(c).to_pylist() for c in ("doc", "material", "base", "key")), strict=True):
            if (doc, material, base) != now:
                now, used, last = (doc, material, base), set(), {}
            name = key
            while name in used:
                last[key] = last.get(key, 0) + 1
                name = f"{key}_{last[key]}"
            used.add(name)
            names.append(name)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "material", "ord", "pos")), pa.array(names, pa.string()), batch.column("value")], ["doc", "material", "ord", "pos", "name", "value"])


def _streamed(rows: DataFrame, keys: list[str], order: list[str], run: Callable, schema: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def assign(records: DataFrame) -> DataFrame:
    """For each record ``doc, ord`` its ``material`` (the ``ord`` of that material's first record) and the material's ``name, symbol, formula, source`` once the record is in.

    ``records`` has ``doc`` and ``ord`` (which together tell rows apart), ``name, symbol, formula, source`` and ``general``.
    Records without a name and symbol are a material each.
    """
    rows = records.select(F.col("doc").cast("string").alias("doc"), F.col("ord").cast("long").alias("ord"), *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("name", "symbol")], "formula", "source", F.coalesce("general", F.lit(False)).alias("general"))
    ident = [F.when(F.col(c).isNotNull(), F.struct(F.coalesce("doc", F.lit("")).alias("d"), F.col(c).alias("i"))) for c in ("name", "symbol")]
    links = rows.where("name is not null and symbol is not null").select(ident[0].alias("a"), ident[1].alias("b")).distinct()
    roots = connected_components(links, "a", "b")
    node = F.coalesce(*ident)
    joined = rows.withColumn("_node", node).join(roots, F.col("_node") == F.col("node"), "left")
    # a record alone is its own component
    root = F.coalesce(F.col("root.i"), F.col("_node.i"))
    component = F.when(root.isNull(), F.concat(F.lit("#"), F.col("ord").cast("string"))).otherwise(F.concat(F.lit("="), root))
    parted = joined.select("doc", component.alias("component"), "ord", "name", "symbol", "formula", "source", "general")
    return _streamed(parted, ["doc", "component"], ["ord"], _gather, _SEEN)


def numbered_data(data: DataFrame) -> DataFrame:
    """``doc, material, ord, pos, name, value``: entries ``doc, material, ord, pos, key, value`` with keys that a material has already numbered ``_1``, ``_2`` and so on.

    Only keys that differ in such endings can meet, so each family of these is gone through by itself.
    """
    based = data.withColumn("base", F.regexp_replace("key", r"(_[0-9]+)+$", ""))
    rows = based.select("doc", "material", "base", "ord", "pos", "key", "value")
    return _streamed(rows, ["doc", "material", "base"], ["ord", "pos"], _number, "doc string, material long, ord long, pos int, name string, value string")


def collect_records(records: DataFrame) -> DataFrame:
    """One row for each material: ``doc, material, records, name, symbol, formula, source, synonyms, refcode, data, elements``.

    ``records`` has the columns of ``assign`` and ``synonyms`` (strings), ``refcode``, ``data`` (a map of strings, taken by key) and
    ``elements`` (strings). Synonyms and refcode are the first that are not empty; elements stand one after another; data are
    numbered where keys repeat (``numbered_data``).
    """
    placed = stage_table(assign(records), "materials")
    whole = records.select(F.col("doc").cast("string").alias("doc"), F.col("ord").cast("long").alias("ord"), "synonyms", "refcode", "data", "elements")
    joined = whole.join(placed.select(F.col("doc").alias("_d"), F.col("ord").alias("_o"), "material"), F.col("doc").eqNullSafe(F.col("_d")) & (F.col("ord") == F.col("_o"))).drop("_d", "_o")
    state = F.max_by(F.struct("name", "symbol", "formula", "source"), "ord").alias("_s")
    heads = placed.groupBy("doc", "material").agg(F.count("*").alias("records"), state)
    first = [F.min_by(F.when(F.size("synonyms") > 0, F.col("synonyms")), F.when(F.size("synonyms") > 0, F.col("ord"))).alias("synonyms"), F.min_by("refcode", F.when(F.col("refcode") != "", F.col("ord"))).alias("refcode")]
    lists = F.sort_array(F.collect_list(F.struct("ord", F.coalesce("elements", F.array().cast("array<string>")).alias("e")))).alias("_e")
    rest = joined.groupBy("doc", "material").agg(*first, lists).withColumn("elements", F.flatten(F.transform("_e", lambda x: x["e"]))).drop("_e")
    entries = joined.select("doc", "material", "ord", F.posexplode(F.array_sort(F.map_entries("data"))).alias("pos", "_kv")).select("doc", "material", "ord", "pos", F.col("_kv.key").alias("key"), F.col("_kv.value").alias("value"))
    ordered = F.sort_array(F.collect_list(F.struct("ord", "pos", "name", "value")))
    data = numbered_data(entries).groupBy("doc", "material").agg(F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["name"], x["value"]))).alias("data"))

    def same(other: str) -> F.Column:
        return F.col("doc").eqNullSafe(F.col(f"{other}_doc")) & (F.col("material") == F.col(f"{other}_material"))

    sides = {k: t.withColumnsRenamed({"doc": f"{k}_doc", "material": f"{k}_material"}) for k, t in (("r", rest), ("d", data))}
    out = heads.join(sides["r"], same("r"), "left").join(sides["d"], same("d"), "left")
    return out.select("doc", "material", "records", "_s.*", "synonyms", "refcode", F.coalesce("data", F.create_map().cast("map<string,string>")).alias("data"), "elements")
