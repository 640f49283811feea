"""Queries of the similarity joins and the collector: names that only tokens, containment, suffixes, descent or order link."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import collect, similar
from marlstone.plans.queries import query, table
from marlstone.sources import nested

_KEY = "lower(regexp_replace({0}, '[^A-Za-z0-9]+', '', 'g'))"
_TOKENS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''))"
_SAMPLE = "upper(regexp_replace({0}, '[^A-Za-z0-9.-]+', '', 'g'))"
#: Names of a brand as samples are written: turned around, with a suffix, abbreviated, as a product of two.
_ASKED_SQL = """SELECT p_partkey, p_brand, CASE p_partkey % 5 WHEN 0 THEN split_part(p_name, ' ', 2) || '-' || split_part(p_name, ' ', 1) || ' mk' || p_size WHEN 1 THEN upper(p_name) || '-' || p_size
  WHEN 2 THEN split_part(p_name, ' ', 1) || ' modified with ' || split_part(p_name, ' ', 2) WHEN 3 THEN p_type || ' ' || split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 2) END AS asked FROM part"""
_KNOWN_SQL = "SELECT p_brand, p_name || ' ' || p_type AS known, min(p_partkey) AS ord FROM part GROUP BY ALL"


def _asked(part: DataFrame) -> DataFrame:
    word = F.split("p_name", " ")
    kind = F.col("p_partkey") % 5
    turned = F.concat(word[1], F.lit("-"), word[0], F.lit(" mk"), F.col("p_size").cast("string"))
    made = F.concat(word[0], F.lit(" modified with "), word[1])
    asked = F.when(kind == 0, turned).when(kind == 1, F.concat(F.upper("p_name"), F.lit("-"), F.col("p_size").cast("string"))).when(kind == 2, made).when(kind == 3, F.concat("p_type", F.lit(" "), word[1])).otherwise(word[1])
    return part.select("p_partkey", "p_brand", asked.alias("asked"))


def _known(part: DataFrame) -> DataFrame:
    return part.groupBy("p_brand", F.concat("p_name", F.lit(" "), "p_type").alias("known")).agg(F.min("p_partkey").alias("ord"))


@query(f"""
WITH a AS (SELECT *, {_KEY.format('asked')} AS ka, {_TOKENS.format('asked')} AS ta FROM ({_ASKED_SQL})), b AS (SELECT *, {_KEY.format('known')} AS kb, {_TOKENS.format('known')} AS tb FROM ({_KNOWN_SQL})),
s AS (SELECT p_partkey, known, CASE WHEN ka = kb THEN 1.0 WHEN contains(ka, kb) OR contains(kb, ka) THEN greatest(0.65::DOUBLE, least(len(ka), len(kb))::DOUBLE / greatest(len(ka), len(kb)))
  ELSE len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(ta || tb)) END::DOUBLE AS score FROM a JOIN b USING (p_brand))
SELECT p_partkey, known, score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, known) AS rn FROM s WHERE score >= 0.3) WHERE rn = 1""")
def fuzzy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part, by a distorted name, the best name of its brand by equality, containment or shared tokens."""
    part = table(spark, sf_dir, "part")
    return similar.fuzzy_top1(_asked(part), _known(part), ["p_brand"], "p_partkey", "asked", "known", tokens=True)


@query(f"""
WITH a AS (SELECT *, {_SAMPLE.format('asked')} AS ka, {_TOKENS.format('asked')} AS ta, {_SAMPLE.format("regexp_extract(asked, '(?i)^[ ]*([A-Za-z0-9+-]+) +modified +with +([A-Za-z0-9+-]+)[ ]*$', 1)")} AS m1,
    {_SAMPLE.format("regexp_extract(asked, '(?i)^[ ]*([A-Za-z0-9+-]+) +modified +with +([A-Za-z0-9+-]+)[ ]*$', 2)")} AS m2 FROM ({_ASKED_SQL})),
b AS (SELECT *, {_SAMPLE.format('known')} AS kb, {_TOKENS.format('known')} AS tb FROM (SELECT p_brand, arg_min(known, ord) AS known, min(ord) AS ord FROM ({_KNOWN_SQL}) GROUP BY p_brand, {_SAMPLE.format('known')})),
s AS (SELECT p_partkey, known, CASE WHEN ka = kb THEN 1 WHEN m1 <> '' AND m2 <> '' AND contains(kb, m1) AND contains(kb, m2) THEN 2 WHEN len(list_intersect(ta, tb)) >= 2 THEN 3 END AS r,
  CASE WHEN ka = kb OR (m1 <> '' AND m2 <> '' AND contains(kb, m1) AND contains(kb, m2)) THEN ord END AS ord, len(list_intersect(ta, tb)) AS n FROM a JOIN b USING (p_brand))
SELECT p_partkey, known, ['key', 'modified', 'tokens'][r] AS rule FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY r, ord, n DESC, known) AS rn FROM s WHERE r IS NOT NULL) WHERE rn = 1""")
def alias_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part, by a distorted name, the name of its brand that it is an alias of, and the rule that says so."""
    part = table(spark, sf_dir, "part")
    return similar.alias(_asked(part), _known(part), ["p_brand"], "p_partkey", "asked", "known", "ord")


#: Classes of the names of a brand, by the size of its first part; samples ask by a part of a name, a longer one or none.
_CLASSES_SQL = f"SELECT p_brand, {_KEY.format('p_name')} AS _k, ['acid', 'other', 'unknown', 'pristine'][min(p_size) % 4 + 1] AS cls FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL"
_SAMPLES_SQL = "SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN p_name || '-2' END AS sample FROM part"


def _classes(part: DataFrame) -> DataFrame:
    cls = F.element_at(F.array(*[F.lit(c) for c in ("acid", "other", "unknown", "pristine")]), (F.min("p_size") % 4 + 1).cast("int"))
    return part.where("p_partkey % 3 = 0").groupBy("p_brand", T.alnum_key(F.col("p_name")).alias("_k")).agg(cls.alias("cls"))


@query(f"""
WITH c AS ({_CLASSES_SQL}), s AS (SELECT *, {_KEY.format("coalesce(sample, '')")} AS k FROM ({_SAMPLES_SQL})),
kept AS (SELECT * FROM c WHERE cls IN ('acid', 'pristine')), one AS (SELECT p_brand, min(cls) AS cls FROM kept GROUP BY 1 HAVING count(DISTINCT cls) = 1),
direct AS (SELECT p_partkey, 1 AS r, cls FROM s JOIN kept USING (p_brand) WHERE k = _k),
near AS (SELECT p_partkey, 2 AS r, arg_min(cls, {{'a': -greatest(0.65::DOUBLE, least(len(k), len(_k))::DOUBLE / greatest(len(k), len(_k))), 'b': _k}}) AS cls FROM s JOIN kept USING (p_brand) WHERE k <> '' AND (contains(k, _k) OR contains(_k, k)) GROUP BY 1),
suffix AS (SELECT DISTINCT p_partkey, 3 AS r, 'pristine' AS cls FROM s JOIN c USING (p_brand) WHERE k <> '' AND k <> _k AND ends_with(_k, k)),
blank AS (SELECT p_partkey, 4 AS r, cls FROM s JOIN one USING (p_brand) WHERE k = ''),
every AS (FROM direct UNION ALL FROM near UNION ALL FROM suffix UNION ALL FROM blank)
SELECT p_partkey, arg_min(cls, r) AS cls, ['key', 'similar', 'suffix', 'block'][min(r)] AS rule FROM every GROUP BY 1""")
def context_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part the class that the other names of its brand give it, and the rule that says so."""
    part = table(spark, sf_dir, "part")
    word = F.split("p_name", " ")
    sample = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, word[1]).when(F.col("p_partkey") % 4 == 2, F.concat("p_name", F.lit("-2")))
    samples = part.select("p_partkey", "p_brand", sample.alias("sample"))
    return similar.inferred_class(samples, _classes(part), ["p_brand"], "p_partkey", "sample", "cls", ("acid", "pristine"), "pristine")


@query(f"""
WITH RECURSIVE k AS (SELECT p_brand, repeat('n', p_partkey % 4) || {_KEY.format("split_part(p_name, ' ', 2)")} AS _k, ['acid', 'other', 'unknown', 'other', 'other'][min(p_size) % 5 + 1] AS cls FROM part GROUP BY ALL),
d AS (SELECT p_brand, _k FROM k WHERE cls IN ('acid', 'pristine') UNION SELECT k.p_brand, k._k FROM d JOIN k ON k.p_brand = d.p_brand AND k._k = 'n' || d._k)
SELECT DISTINCT k.p_brand, k._k AS name FROM k JOIN d ON k.p_brand = d.p_brand AND k._k = 'n' || d._k""")
def family_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a brand that descend, a letter at a time, from one of a kept class."""
    part = table(spark, sf_dir, "part")
    key = F.concat(F.repeat(F.lit("n"), (F.col("p_partkey") % 4).cast("int")), T.alnum_key(F.split("p_name", " ")[1]))
    cls = F.element_at(F.array(*[F.lit(c) for c in ("acid", "other", "unknown", "other", "other")]), (F.min("p_size") % 5 + 1).cast("int"))
    known = part.groupBy("p_brand", key.alias("_k")).agg(cls.alias("cls"))
    return similar.family_class(known, ["p_brand"], "cls", ("acid", "pristine")).withColumnRenamed("_k", "name")


def part_records(part: DataFrame) -> DataFrame:
    """Parts as records of materials: of a brand, by part number, named by a word and a size or not at all."""
    word, size = F.split("p_name", " "), F.col("p_size")
    name = F.when(size % 4 > 0, F.concat(word[0], (size % 7).cast("string")))
    symbol = F.when(size % 3 == 0, F.concat(word[0], ((size + 1) % 7).cast("string"))).when(size % 3 == 1, word[1])
    source = F.element_at(F.array(F.lit("text"), F.lit("table"), F.lit(collect.SYNTHESIS)), (size % 3 + 1).cast("int"))
    data = F.create_map(F.lit("size"), size.cast("string"), F.concat(F.lit("size_"), (size % 3).cast("string")), F.col("p_type"))
    return part.select(
        F.col("p_brand").alias("doc"), F.col("p_partkey").alias("ord"), name.alias("name"), symbol.alias("symbol"), F.when(size % 5 > 0, F.col("p_type")).alias("formula"), source.alias("source"), (size % 2 == 0).alias("general"),
        F.when(size % 6 == 0, F.array("p_type")).alias("synonyms"), F.when(size % 8 == 0, F.col("p_name")).alias("refcode"), data.alias("data"), F.array(F.col("p_partkey").cast("string")).alias("elements"),
    )


@query()
def collected_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts brought together as materials of their brand; order decides, so plain Python states it in the tests."""
    found = collect.collect_records(part_records(table(spark, sf_dir, "part")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(e.key, F.lit("="), e.value)), ";")
    return found.select("doc", "material", "records", "name", "symbol", "formula", "source", F.array_join("synonyms", ";").alias("synonyms"), "refcode", text.alias("data"), F.array_join("elements", ";").alias("elements"))


@query("""
SELECT o_orderkey, 'materials' AS key, '$.data.materials' AS at, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS amount FROM orders
UNION ALL SELECT o_orderkey, 'materials', '$.data.materials', o_orderpriority, NULL FROM orders
UNION ALL SELECT o_orderkey, 'Materials-2', 'inner', o_orderstatus, CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 2 = 0""")
def nested_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records under a key, wherever it stands, in nested JSON made of every order."""
    made = table(spark, sf_dir, "orders").selectExpr("o_orderkey", """concat('{"doi": "', o_orderkey, '", "data": {"materials": [{"status": "', o_orderstatus, '", "amount": ', o_custkey, '}, "none", {"status": "', o_orderpriority, '", "amount": null}], "rest": [',
      if(o_orderkey % 2 = 0, concat('[{"Materials-2": {"status": "', o_orderstatus, '", "amount": ', o_orderkey, ', "deep": 1}}]'), '7'), ']}}') as js""")
    found = nested.nested_rows(made, "o_orderkey", "js", ["materials"])
    at = F.when(F.map_contains_key("row", "deep"), "inner").otherwise("$.data.materials")
    return found.select("o_orderkey", "key", at.alias("at"), F.col("row")["status"].alias("status"), F.col("row")["amount"].alias("amount"))
