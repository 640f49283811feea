"""Queries of mining, links, guards, families and statistics over the driver's tables, beside their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import fill, measures, mining, records, resample, resolve
from marlstone.plans import export
from marlstone.plans.queries import query, table
from marlstone.sources import documents, publishers
from marlstone.staging import stage_table


def _pick(values: list[str | None], at: Column) -> Column:
    """One of a few given texts, by a number."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), at.cast("int"))


def _sql_list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


# ---------------------------------------------------------------- texts
_NEAR = mining.Pattern("count", r"(\d+)\s*[a-z]", 1, 100000, ("the", "und"), 40, 30)
_PLAIN = mining.Pattern("any", r"(\d+)", 1, 1000000)


@query(r"""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract_all(t, '(\d+)\s*[a-z]') AS f, regexp_extract_all(t, '(\d+)\s*[a-z]', 1) AS n, string_split_regex(t, '(\d+)\s*[a-z]') AS g FROM d),
p AS (SELECT doc_id, t, f[i] AS f, n[i] AS n, coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: len(x))), 0) AS pos FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m)),
v AS (
  SELECT doc_id, 'count' AS field, CAST(n AS HUGEINT) AS x FROM p WHERE len(n) < 9 AND (contains(t[CAST(greatest(pos - 40, 0) + 1 AS BIGINT):CAST(pos + len(f) + 30 AS BIGINT)], 'the') OR contains(t[CAST(greatest(pos - 40, 0) + 1 AS BIGINT):CAST(pos + len(f) + 30 AS BIGINT)], 'und'))
  UNION ALL SELECT doc_id, 'any', CAST(n AS HUGEINT) FROM (SELECT doc_id, unnest(regexp_extract_all(t, '(\d+)')) AS n FROM d) WHERE len(n) < 9
), c AS (SELECT doc_id, field, x, count(*) AS k FROM v WHERE x >= 1 AND x <= CASE field WHEN 'count' THEN 100000 ELSE 1000000 END GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY doc_id, field ORDER BY k DESC) AS r FROM c)
SELECT doc_id, field, CASE WHEN max(x) = 1000000 THEN '1e+06' ELSE CAST(max(x) AS VARCHAR) END AS value FROM r WHERE r = 1 GROUP BY ALL HAVING count(*) = 1""")
def mined_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the strictly commonest number, and the commonest before a letter with a cue word around."""
    return mining.mined_values(table(spark, sf_dir, "documents"), "doc_id", "text", [_NEAR, _PLAIN])


@query(r"""
WITH p AS (SELECT page_id, url AS base, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, html FROM pages),
a AS (SELECT *, regexp_extract(a, '(?is)^<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(regexp_extract(a, '(?is)<a\b([^>]*)>(.*?)</a\s*>', 2), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM (SELECT * EXCLUDE (html), unnest(regexp_extract_all(html, '(?is)<a\b([^>]*)>(.*?)</a\s*>')) AS a FROM p)),
u AS (SELECT DISTINCT page_id, label, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN host || href WHEN starts_with(href, '#') THEN regexp_replace(base, '#.*$', '') || href
  WHEN starts_with(href, '?') THEN host || path || href ELSE host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || href END AS url FROM a WHERE href <> ''),
s AS (SELECT *, lower(label || ' ' || url) AS w FROM u),
k AS (SELECT *, CASE WHEN contains(w, 'une') THEN -999 ELSE 5 * (CAST(contains(w, 'the') AS INTEGER) + CAST(contains(w, 'und') AS INTEGER)) + 2 * (CAST(contains(w, 'er') AS INTEGER) + CAST(contains(w, 'la') AS INTEGER))
  + 8 * CAST(lower(regexp_extract(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '[^/](\.[^./]+)$', 1)) IN ('.pdf', '.zip', '.txt') AS INTEGER) + 2 * CAST(contains(w, 'download') AS INTEGER) END AS score FROM s)
SELECT page_id, label, url, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url, label) AS rank FROM k WHERE score > 0) WHERE rank <= 12""")
def candidate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best links of every page by label and address."""
    links = mining.page_links(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return mining.candidate_links(links, "page_id", keywords=["the", "und"], hints=["er", "la"], excluded=["une"])


_MD = "CASE WHEN doc_id % 3 = 0 THEN replace(text, '. ', '.' || chr(10) || ' ' || chr(10)) || chr(10) || chr(10) || '| a | b |' || chr(10) || '|:---|---:|' || chr(10) || '| 1 | ' || doc_id || ' |' WHEN doc_id % 3 = 1 THEN replace(text, ', ', chr(10) || chr(10) || '| x' || chr(10)) ELSE text END"


@query(rf"""
WITH b AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex({_MD}, '\n\s*\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')) AS b FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM b),
k AS (SELECT doc_id, len(l) >= 2 AND contains(l[1], '|') AND len(list_filter(l[2:3], lambda x: regexp_matches(x, '^\|?\s*:?-{{3,}}:?\s*(\|\s*:?-{{3,}}:?\s*)+\|?$'))) > 0 AS is_table FROM l)
SELECT doc_id, count(*) FILTER (WHERE is_table) AS tables, count(*) FILTER (WHERE NOT is_table) AS texts FROM k GROUP BY 1""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table and text blocks of every document written as Markdown."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.markdown_blocks(F.expr(_MD.replace("chr(10)", "char(10)")))).alias("b"))
    return docs.groupBy("doc_id").agg(F.count_if(F.col("b.kind") == "table").alias("tables"), F.count_if(F.col("b.kind") == "text").alias("texts"))


@query("""
SELECT doc_id, (contains(lower(text), 'acid') OR contains(lower(text), 'tion') OR contains(lower(text), 'die ')) AND regexp_matches(text, '[0-9]') AS signal FROM documents""")
def numeric_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a topic word and a number."""
    return table(spark, sf_dir, "documents").select("doc_id", T.has_number_about(F.col("text"), ["acid", "tion", "die "]).alias("signal"))


_TYPES = ["application/PDF", "text/html", None, "application/zip", "image/jpeg", "text/plain; charset=utf-8", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"]
_ENDS = [".pdf", "/a.b/c", ".Docx?x=.pdf", "", ".exe"]


@query(rf"""
WITH p AS (SELECT page_id, url || {_sql_list(_ENDS)}[CAST(page_id % 5 + 1 AS INTEGER)] AS url, lower(coalesce({_sql_list(_TYPES)}[CAST(page_id % 7 + 1 AS INTEGER)], '')) AS kind FROM pages),
e AS (SELECT *, lower(regexp_extract(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '[^/](\.[^./]+)$', 1)) AS e FROM p)
SELECT page_id, CASE WHEN e IN ({", ".join(f"'{x}'" for x in T.FILE_EXTENSIONS)}) THEN e {" ".join(f"WHEN contains(kind, '{w}') THEN '{x}'" for w, x in T.CONTENT_TYPES)} ELSE '.bin' END AS extension FROM e""")
def file_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.file_extension(F.concat("url", _pick(_ENDS, F.col("page_id") % 5)), _pick(_TYPES, F.col("page_id") % 7)).alias("extension"))


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 4 <> 0 THEN 'https://doi.org/10.1000/' || page_id WHEN page_id % 3 = 1 THEN 'doi:' || page_id ELSE '' END AS link FROM pages""")
def pick_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    link = F.when(k % 3 == 0, F.col("url")).when(k % 3 == 1, F.concat(F.lit("doi:"), k))
    doi = F.when(k % 4 != 0, F.concat(F.lit(" 10.1000/"), k))
    return table(spark, sf_dir, "pages").select("page_id", T.pick_url(doi, link).alias("link"))


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '.pdf' AS name FROM pages)
SELECT page_id, CASE WHEN n = 1 THEN name ELSE left(name, -4) || '__' || (n - 1) || '.pdf' END AS target FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) AS n FROM p)""")
def collected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names under which files are collected: later files of one name are numbered."""
    files = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.lit(".pdf")).alias("name"))
    return documents.unique_names(files, "name", "page_id").select("page_id", "target")


@query("""
WITH r AS (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN '10.1000/' || page_id // 4 END AS doi, CASE WHEN page_id % 5 <> 0 THEN url END AS link FROM pages),
k AS (SELECT *, coalesce(doi, link) AS k FROM r WHERE doi IS NOT NULL OR link IS NOT NULL)
SELECT page_id, doi, link FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY page_id) AS rn FROM k) WHERE rn = 1""")
def doi_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a list of articles by whatever its columns are called: the first of each DOI, or of each link without one."""
    k = F.col("page_id")
    sheet = table(spark, sf_dir, "pages").select("page_id", F.when(k % 3 != 0, F.concat(F.lit("see 10.1000/"), F.floor(k / 4), F.lit("."))).alias("Article DOI"), F.when(k % 5 != 0, F.col("url")).alias("DOI link"))
    return documents.article_list(sheet.withColumnRenamed("Article DOI", "doi "), "page_id").select("page_id", "doi", "link")


@query()
def article_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of every page read as a publisher's article; the tests hold each dialect against hand-made articles."""
    return publishers.articles(table(spark, sf_dir, "pages"), "page_id", "html", "rsc")


# ---------------------------------------------------------------- samples
_FAMILY_CASES = [
    ("BC", "BC"), ("bc-HNO3", "BC"), ("HNO3_BC", "BC"), ("APBC", "PBC"), ("x-OPBC", "PBC"), ("HMB", "MB"), ("NaMB", "MB"), ("ACID-PBC500", "ACIDPBC500"), ("N SC", "SC"), (None, ""), ("S-1", "S1"), ("PBC", "PBC"), ("*", "*"),
]


@query(f"SELECT p_partkey, {_sql_list([f for _, f in _FAMILY_CASES])}[CAST(p_partkey % {len(_FAMILY_CASES)} + 1 AS INTEGER)] AS family, p_partkey % {len(_FAMILY_CASES)} IN (0, 11) AS base FROM part")
def sample_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base material of sample ids of every kind, dealt to the parts by key."""
    sid = _pick([s for s, _ in _FAMILY_CASES], F.col("p_partkey") % len(_FAMILY_CASES))
    return table(spark, sf_dir, "part").select("p_partkey", T.sample_family(sid).alias("family"), (T.is_base_of(sid, T.sample_family(sid)) & T.sample_family(sid).isin(resolve.BASES)).alias("base"))


#: An id and a temperature cell; whether it is a design run, cited, a reagent; the one temperature.
_GUARD_CASES = [
    ("SCRH-S-20-160", None, False, False, False, "160"), ("SCRH-W-0.5-180", "160, 180", False, False, False, "180"), ("scrh-s-20-160", "150", False, False, False, "150"), ("SCRH-S-m-T", "1/2", False, False, False, "1/2"),
    ("B12", "500 600", True, False, False, "500 600"), ("PF-Biochar */MB [38, 4]", "5", False, True, False, "5"), ("Li et al. 2019", None, False, True, False, None), ("nitric acid", None, False, False, True, None),
    ("nitric acid BC", None, False, False, False, None), ("Sulfuric acid char", "7", False, False, False, "7"), (None, "3", False, False, False, "3"),
]


def _guard_sql() -> str:
    n = len(_GUARD_CASES)
    flags = ", ".join(f"[{', '.join(str(c[2 + k]).lower() for c in _GUARD_CASES)}][CAST(p_partkey % {n} + 1 AS INTEGER)] AS {name}" for k, name in enumerate(("design_run", "cited", "reagent")))
    return f"SELECT p_partkey, {flags}, {_sql_list([c[5] for c in _GUARD_CASES])}[CAST(p_partkey % {n} + 1 AS INTEGER)] AS temperature FROM part"


@query(_guard_sql())
def sample_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids are none of a sample, and the one temperature of condition points."""
    from marlstone.plans import vocabulary as V

    at = F.col("p_partkey") % len(_GUARD_CASES)
    sid, cell = (_pick([c[k] for c in _GUARD_CASES], at) for k in (0, 1))
    return table(spark, sf_dir, "part").select(
        "p_partkey", resolve.design_run(sid).alias("design_run"), resolve.cited(sid).alias("cited"), resolve.reagent(sid, V.REAGENT_IDS).alias("reagent"), resolve.single_temperature(sid, cell).alias("temperature")
    )


_RANKS = ["unknown", "other", "pristine", "acid"]
_CLASS_SQL = "CASE WHEN quality = 1 AND toxic = 0 THEN 4 WHEN quality = 1 THEN 3 WHEN toxic = 1 THEN 2 ELSE 1 END"


@query(f"""
WITH c AS (SELECT lang, source, max({_CLASS_SQL}) AS k FROM documents JOIN labels USING (doc_id) GROUP BY ALL), g AS (SELECT source, max(k) AS k FROM c GROUP BY 1)
SELECT doc_id, coalesce({_sql_list(_RANKS)}[c.k], {_sql_list(_RANKS)}[g.k], CASE WHEN n_chars > 2000 THEN 'pristine' ELSE 'unknown' END) AS class FROM documents LEFT JOIN c USING (lang, source) LEFT JOIN g USING (source)""")
def class_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document: that of its language and source, else of its source anywhere, else inferred."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    cls = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "acid").when(F.col("quality") == 1, "pristine").when(F.col("toxic") == 1, "other").otherwise("unknown")
    classes = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "source", cls.alias("class"))
    out = resolve.class_of(docs, classes, ["lang"], "source", "class", _RANKS, F.when(F.col("n_chars") > 2000, "pristine").otherwise("unknown"))
    return out.select("doc_id", "class")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS st, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS pr FROM orders),
u AS (SELECT o_custkey, CASE WHEN min(st) = max(st) THEN min(st) END AS s, CASE WHEN min(pr) = max(pr) THEN min(pr) END AS p FROM o GROUP BY 1)
SELECT 'st' AS field, count(*) FILTER (WHERE st IS NULL AND s IS NOT NULL) AS filled, 0::BIGINT AS cleared, 0::BIGINT AS changed, count(*) AS rows FROM o JOIN u USING (o_custkey)
UNION ALL SELECT 'pr', count(*) FILTER (WHERE pr IS NULL AND p IS NOT NULL), 0, 0, count(*) FROM o JOIN u USING (o_custkey)""")
def fill_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a filling step did, by field."""
    key = F.col("o_orderkey")
    before = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(key % 3 != 0, F.col("o_orderstatus")).alias("st"), F.when(key % 2 == 0, F.col("o_orderpriority")).alias("pr"))
    seen = Observation("fills")
    stage_table(fill.fill_unique(before, ["o_custkey"], ["st", "pr"], seen), "filled")  # counted as the filled table is written
    counts = seen.get
    rows = [(c, counts[f"filled_{c}"], 0, 0, counts["rows"]) for c in ("st", "pr")]
    return spark.createDataFrame(rows, "field string, filled long, cleared long, changed long, rows long")


@query("""
WITH s AS (SELECT p_brand, p_size, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS t, p_partkey FROM part), c AS (SELECT p_brand, t, count(*) AS n FROM s WHERE t IS NOT NULL GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY n DESC) AS r FROM c)
SELECT p_brand, max(t) AS t FROM r WHERE r = 1 GROUP BY 1 HAVING count(*) = 1""")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strictly commonest type of every brand."""
    part = table(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("t")).where("t is not null")
    return mining.most_frequent(part, ["p_brand"], "t")


# ---------------------------------------------------------------- the exporter over raw rows made from whole tables
def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw material rows of every part and raw adsorption rows of every customer, of some hundred papers."""
    k, c = F.col("p_partkey"), F.col("c_custkey")
    sid = F.concat(_pick(["BC", "BC-HCl", "PBC", "APBC-HNO3", "MB-H3PO4", None], k % 6), F.when(k % 5 == 0, F.concat(F.lit("-"), F.col("p_size"))).otherwise(F.lit("")))
    acid = F.when(k % 6 == 1, "HCl").when(k % 6 == 3, "HNO3").when(k % 6 == 4, "H3PO4")
    paper = F.concat(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit("-"), F.col("p_partkey") % 40)
    fields = {"sample_id": sid, "acid_type": acid, "acid_conc_mol_L": F.when((k % 6 == 1) & (k % 7 == 0), F.lit("1 M")), "pyrolysis_temp_C": F.when(k % 7 < 2, F.lit("500")), "SSA_m2_g": F.when(k % 3 == 0, F.col("p_retailprice").cast("string")), "biomass_source": F.when(k % 11 == 0, F.col("p_type"))}
    pairs = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[v.cast("string") for v in fields.values()])), lambda _, v: v.isNotNull())
    materials = table(spark, sf_dir, "part").select(F.concat(paper, F.when(k % 2 == 0, "-main.pdf").otherwise("-mmc1.docx")).alias("filename"), k.alias("ord"), pairs.alias("row"))
    fields = {"sample_id": _pick(["BC", "BC-HCl", None, "APBC-HNO3"], c % 4), "pollutant_name": _pick(["U(VI)", "Cs(I)", "Sr(II)"], c % 3), "T_K": _pick(["25 °C", "298 K", None], c % 3), "pH": F.when(c % 5 != 0, (c % 4 + 3).cast("string")), "Qmax": F.when(c % 2 == 0, F.round("c_acctbal", 0).cast("string"))}
    pairs = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[v.cast("string") for v in fields.values()])), lambda _, v: v.isNotNull())
    adsorption = table(spark, sf_dir, "customer").select(F.concat(F.lit("brand"), c % 25 + 1, F.lit("-"), c % 40, F.lit("-main.pdf")).alias("filename"), c.alias("ord"), pairs.alias("row"))
    return materials, adsorption


@query()
def export_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exporter's first table; its order-dependent steps are no SQL, the tests hold each against plain Python."""
    return export.export_tables(*_raw(spark, sf_dir))[0]


# ---------------------------------------------------------------- statistics
def _price_terms(flag: Column, quantity: Column) -> dict[str, Column]:
    return {"quantity": quantity, **dict(zip(("flag_N", "flag_R"), measures.one_hot(flag, ["A", "N", "R"]), strict=True))}


@query()
def standardized_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised mean prices by return flag on the model's log scale; the tests hold them against numpy."""
    line = table(spark, sf_dir, "lineitem").withColumn("_log", F.log("l_extendedprice"))
    fit = measures.least_squares(line, _price_terms(F.col("l_returnflag"), F.col("l_quantity")), "_log")
    rows = measures.standardized_means(line, fit, {f: _price_terms(F.lit(f), F.col("l_quantity")) for f in "ANR"}, math.exp)
    return spark.createDataFrame([tuple(r.values()) for r in rows], "flag string, estimate double, low double, high double")


@query("""
WITH f AS (SELECT regr_r2(l_extendedprice, l_quantity) AS q, regr_r2(l_extendedprice, l_discount) AS d, corr(l_quantity, l_discount) AS c, corr(l_extendedprice, l_quantity) AS a, corr(l_extendedprice, l_discount) AS b FROM lineitem),
r AS (SELECT *, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS r2 FROM f)
SELECT 'quantity' AS block, round(r2 - d, 6) AS delta_r2, round((r2 - d) / (1 - d), 6) AS partial_r2 FROM r UNION ALL SELECT 'discount', round(r2 - q, 6), round((r2 - q) / (1 - q), 6) FROM r""")
def block_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What price loses in R squared without quantity or discount, and the partial R squared of each."""
    line = table(spark, sf_dir, "lineitem")
    rows = measures.block_contributions(line, {"quantity": {"q": F.col("l_quantity")}, "discount": {"d": F.col("l_discount")}}, "l_extendedprice")
    return spark.createDataFrame([(r["block"], round(r["delta_r2"], 6), round(r["partial_r2"], 6)) for r in rows], "block string, delta_r2 double, partial_r2 double")


@query()
def refit_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of order price on year with customers as clusters, refitted to resamples; the tests hold it against numpy."""
    orders = table(spark, sf_dir, "orders")
    return resample.refit_bootstrap(orders, "o_custkey", {"year": F.year("o_orderdate") - 1995.0}, "o_totalprice", 200)
