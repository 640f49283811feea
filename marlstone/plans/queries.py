"""One query for each operator over the driver's tables, beside the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.agents import seam
from marlstone.operators import fill, match, measures, records, resample, similar
from marlstone.plans import screening
from marlstone.plans import vocabulary as V
from marlstone.sources import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a scan has fewer tasks than these: a small table may be one row group. A larger scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.lower().replace("'", "''") + "'" for w in words) + "]"


_FOLD = r"lower(trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')))"


# ---------------------------------------------------------------- screening
def _screen_sql() -> str:
    hits = ", ".join(f"len(list_filter({_list(words)}, lambda k: contains(t, k))) AS n_{name}" for name, words in screening.KEYWORD_SIGNALS.items())
    return f"""
WITH s AS (SELECT doc_id, {_FOLD} AS t FROM documents), h AS (SELECT doc_id, t, {hits},
  len(regexp_extract_all(t, '(?i)\\btable\\s*\\d+\\b')) AS table_hits, len(regexp_extract_all(t, '(?i){V.UNIT}')) AS unit_hits, len(t) AS text_chars FROM s)
SELECT doc_id, CAST(n_topic AS INTEGER) AS n_topic, CAST(n_method AS INTEGER) AS n_method, CAST(n_data + least(table_hits, 5) AS INTEGER) AS data_score,
  CAST(n_topic * 4 + n_method * 2 + n_data + least(table_hits, 5) AS INTEGER) AS score_total, CAST(text_chars AS INTEGER) AS text_chars,
  CASE WHEN text_chars < 3000 THEN 'FAIL' WHEN n_topic >= 3 AND n_method >= 1 AND (n_data + least(table_hits, 5) >= 4 OR unit_hits >= 8) THEN 'PASS'
    WHEN n_topic >= 2 AND (n_data + least(table_hits, 5) >= 2 OR unit_hits >= 4) THEN 'MAYBE' ELSE 'FAIL' END AS status FROM h"""


@query(_screen_sql())
def screen_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the legacy profile for every document."""
    out = screening.screen(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_topic", "n_method", "data_score", "score_total", "text_chars", "status")


@query(f"""
WITH s AS (SELECT doc_id, {_FOLD} AS t FROM documents), p AS (SELECT unnest(['legacy', 'acid-biochar-strict', 'acid-biochar-radionuclide', 'acid-biochar-radionuclide-loose']) AS profile),
h AS (SELECT profile, len(t) < 3000 AS short, len(list_filter({_list(V.REVIEW)}, lambda k: contains(t, k))) > 0 AND len(list_filter({_list(V.METHOD)}, lambda k: contains(t, k))) <= 2 AS review,
  len(list_filter({_list(V.TOPIC)}, lambda k: contains(t, k))) = 0 OR len(list_filter({_list(V.BIOCHAR_PREPARATION)}, lambda k: contains(t, k))) = 0 AS off FROM s, p)
SELECT profile, CASE WHEN short THEN 'Likely scanned PDF or low selectable text; OCR needed first.'
  WHEN profile = 'legacy' THEN 'Weak topic or insufficient extractable structured signals.'
  WHEN review THEN 'Review/conceptual article likely; lacks primary experimental focus.' WHEN off THEN 'No clear biochar preparation context.' ELSE 'later rule' END AS reason, count(*) AS docs
FROM h GROUP BY ALL""")
def screen_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by profile and reason."""
    found = screening.signals(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return screening.verdicts(found).groupBy("profile", "reason").agg(F.count("*").alias("docs"))


@query(r"""
SELECT doc_id, CAST(len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS INTEGER) AS sentences FROM documents""")
def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


@query(r"""
WITH s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS l FROM documents)),
f AS (SELECT doc_id, pos, contains(s, 'the') AS a, contains(s, 'ing') AS b, lead(contains(s, 'the')) OVER w AS a2, lead(contains(s, 'ing')) OVER w AS b2 FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT documents.doc_id, CAST(coalesce(sum(CASE WHEN (a AND b) OR (a AND coalesce(b2, false)) OR (b AND coalesce(a2, false)) THEN 1 ELSE 0 END), 0) AS INTEGER) AS windows FROM documents LEFT JOIN f USING (doc_id) GROUP BY documents.doc_id""")
def adjacent_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence windows in which two cues meet, in one sentence or in neighbours."""
    flags = F.transform(T.sentences(F.col("text")), lambda s: F.struct(s.contains("the").alias("prep"), s.contains("ing").alias("cond")))
    docs = table(spark, sf_dir, "documents").select("doc_id", flags.alias("flags"))
    return docs.select("doc_id", screening.adjacent_pairs(F.col("flags")).alias("windows"))


@query(r"""
SELECT doc_id, CAST(len(CASE WHEN p > 0 AND p - 1 > 0.4 * len(text) THEN text[1:p - 1] ELSE text END) AS INTEGER) AS kept, CAST(p AS INTEGER) AS marker
FROM (SELECT doc_id, text, CASE WHEN regexp_matches(lower(text), '(^|[^a-zà-ÿ0-9_])licensed([^a-zà-ÿ0-9_]|$)') THEN instr(lower(text), 'licensed') ELSE 0 END AS p FROM documents)""")
def strip_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without what follows a late marker word."""
    docs = table(spark, sf_dir, "documents")
    at = F.regexp_instr(F.lower("text"), F.lit(r"\blicensed\b"))
    return docs.select("doc_id", F.length(T.strip_tail(F.col("text"), ["licensed"])).alias("kept"), at.alias("marker"))


@query("""
SELECT doc_id, md5(regexp_replace(replace(replace(text, chr(8217), ''''), chr(8211), '-'), '[•∙⋅・]', '·', 'g')) AS folded FROM documents""")
def fold_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold_unicode(F.col("text"))).alias("folded"))


@query(r"""
SELECT page_id, label, url, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url, label) AS rank FROM (
  SELECT page_id, label, url, 5 * (CAST(contains(lower(label || ' ' || url), 'the') AS INTEGER) + CAST(contains(lower(label || ' ' || url), 'und') AS INTEGER)) + 2 * CAST(contains(lower(url), '/a') AS INTEGER) + 1 AS score
  FROM (SELECT DISTINCT page_id, regexp_extract(a, '<a href="([^"]*)"', 1) AS url, regexp_extract(a, '>([^<]*)</a>', 1) AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*"[^>]*>[^<]*</a>')) AS a FROM pages))))
WHERE rank <= 12""")
def links_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best candidate links of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="[^"]*"[^>]*>[^<]*</a>'), F.lit(0))).alias("a"))
    links = pages.select("page_id", F.regexp_extract("a", '<a href="([^"]*)"', 1).alias("url"), F.regexp_extract("a", ">([^<]*)</a>", 1).alias("label")).distinct()
    whole = F.lower(F.concat_ws(" ", "label", "url"))
    score = 5 * (whole.contains("the").cast("int") + whole.contains("und").cast("int")) + 2 * F.lower("url").contains("/a").cast("int") + 1
    return records.number_occurrences(links.withColumn("score", score), ["page_id"], [F.desc("score"), "url", "label"], "rank").where("rank <= 12")


@query(r"""
SELECT page_id, host FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) ORDER BY page_id) AS rn FROM pages) WHERE rn = 1""")
def first_page_of_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-wins dedup by a normalised key."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))
    return records.first_wins(pages, ["host"], ["page_id"])


# ---------------------------------------------------------------- filling
_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CASE WHEN (l_orderkey * 7 + l_linenumber) % 5 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN NULL ELSE l_tax END AS l_tax FROM lineitem"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_tax")
    status = F.when((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 5 != 0, F.col("l_linestatus"))
    return line.withColumn("l_linestatus", status).withColumn("l_tax", F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 != 0, F.col("l_tax")))


@query(f"""
WITH l AS ({_LINES}), u AS (SELECT l_orderkey, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS s, CASE WHEN min(l_tax) = max(l_tax) THEN min(l_tax) END AS t FROM l GROUP BY 1)
SELECT l_orderkey, l_linenumber, coalesce(l_linestatus, s) AS l_linestatus, coalesce(l_tax, t) AS l_tax FROM l JOIN u USING (l_orderkey)""")
def fill_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.fill_unique(_lines(spark, sf_dir), ["l_orderkey"], ["l_linestatus", "l_tax"]).select("l_orderkey", "l_linenumber", "l_linestatus", "l_tax")


@query(f"""
WITH l AS ({_LINES}), c AS (SELECT l_orderkey, l_tax, count(*) AS n FROM l WHERE l_tax IS NOT NULL GROUP BY ALL),
m AS (SELECT l_orderkey, max(l_tax) AS t FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY n DESC) AS r FROM c) WHERE r = 1 GROUP BY 1 HAVING count(*) = 1)
SELECT l_orderkey, l_linenumber, coalesce(l_tax, t) AS l_tax FROM l LEFT JOIN m USING (l_orderkey)""")
def fill_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.fill_mode(_lines(spark, sf_dir), ["l_orderkey"], ["l_tax"]).select("l_orderkey", "l_linenumber", "l_tax")


@query(f"""
WITH l AS ({_LINES}), c1 AS (SELECT l_orderkey, l_tax, count(*) AS n FROM l GROUP BY ALL),
g1 AS (SELECT l_orderkey, count(*) AS rows FROM l GROUP BY 1), m1 AS (SELECT l_orderkey, max(l_tax) AS t FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY n DESC) AS r FROM c1 WHERE l_tax IS NOT NULL) WHERE r = 1 GROUP BY 1 HAVING count(*) = 1),
a AS (SELECT l.* REPLACE (coalesce(l_tax, CASE WHEN rows >= 2 THEN t END) AS l_tax) FROM l JOIN g1 USING (l_orderkey) LEFT JOIN m1 USING (l_orderkey)),
c2 AS (SELECT l_suppkey, l_tax, count(*) AS n FROM a GROUP BY ALL), g2 AS (SELECT l_suppkey, count(*) AS rows FROM a GROUP BY 1),
m2 AS (SELECT l_suppkey, max(l_tax) AS t FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY n DESC) AS r FROM c2 WHERE l_tax IS NOT NULL) WHERE r = 1 GROUP BY 1 HAVING count(*) = 1)
SELECT l_orderkey, l_linenumber, coalesce(l_tax, CASE WHEN rows >= 2 THEN t END) AS l_tax FROM a JOIN g2 USING (l_suppkey) LEFT JOIN m2 USING (l_suppkey)""")
def fill_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict modes by order, then by supplier over what the first level filled."""
    return fill.fill_levels(_lines(spark, sf_dir), [["l_orderkey"], ["l_suppkey"]], ["l_tax"]).select("l_orderkey", "l_linenumber", "l_tax")


@query(f"""
WITH l AS ({_LINES}), e AS (SELECT l_partkey, l_suppkey, l_tax FROM lineitem),
a AS (SELECT l_partkey, l_suppkey, min(l_tax) AS v FROM e GROUP BY ALL HAVING min(l_tax) = max(l_tax)), b AS (SELECT l_partkey, min(l_tax) AS v FROM e GROUP BY ALL HAVING min(l_tax) = max(l_tax)),
c AS (SELECT l_suppkey, min(l_tax) AS v FROM e GROUP BY ALL HAVING min(l_tax) = max(l_tax))
SELECT l_orderkey, l_linenumber, coalesce(l_tax, a.v, b.v, c.v) AS l_tax,
  CASE WHEN l_tax IS NOT NULL THEN NULL WHEN a.v IS NOT NULL THEN 'part+supplier' WHEN b.v IS NOT NULL THEN 'part' WHEN c.v IS NOT NULL THEN 'supplier' END AS l_tax_source
FROM l LEFT JOIN a USING (l_partkey, l_suppkey) LEFT JOIN b USING (l_partkey) LEFT JOIN c USING (l_suppkey)""")
def lookup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls filled from evidence at the first level with a unique value, with the level's name."""
    evidence = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_tax")
    levels = [("part+supplier", ["l_partkey", "l_suppkey"]), ("part", ["l_partkey"]), ("supplier", ["l_suppkey"])]
    return fill.fill_lookup(_lines(spark, sf_dir), evidence, levels, ["l_tax"]).select("l_orderkey", "l_linenumber", "l_tax", "l_tax_source")


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events""")
def fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("carried"))
    return fill.fill_forward(events, ["user_id"], ["ts", "event_id"], ["carried"]).drop("ts")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS st FROM orders), u AS (SELECT o_custkey, min(st) AS t FROM o GROUP BY 1 HAVING min(st) = max(st))
SELECT o_orderkey, 'st' AS field, t AS value FROM o JOIN u USING (o_custkey) WHERE st IS NULL""")
def fill_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fill has put in."""
    before = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("st"))
    return fill.audit(before, fill.fill_unique(before, ["o_custkey"], ["st"]), ["o_orderkey"], ["st"])


# ---------------------------------------------------------------- matching
@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def left_join_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return match.join_many_to_one(line, table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_partkey"]).drop("p_partkey")


@query("""
SELECT n_regionkey, a.n AS nations, b.n AS customers FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) a
JOIN (SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) b USING (n_regionkey)""")
def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    a = nation.groupBy("n_regionkey").agg(F.count("*").alias("nations"))
    b = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("customers"))
    return match.join_one_to_one(a, b, ["n_regionkey"])


@query("""
WITH c AS (SELECT o_custkey, o_orderkey AS cand, o_orderstatus, o_orderpriority, CAST(floor(o_totalprice / 50000) AS BIGINT) AS band FROM orders WHERE o_orderkey % 2 = 0),
r AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, CAST(floor(o_totalprice / 50000) AS BIGINT) AS band FROM orders WHERE o_orderkey % 2 = 1),
s AS (SELECT o_orderkey, cand, CAST(r.o_orderstatus = c.o_orderstatus AS INTEGER) + CAST(r.o_orderpriority = c.o_orderpriority AS INTEGER) + CAST(r.band = c.band AS INTEGER) AS score FROM r JOIN c USING (o_custkey)),
k AS (SELECT *, rank() OVER (PARTITION BY o_orderkey ORDER BY score DESC) AS rk FROM s WHERE score >= 2)
SELECT o_orderkey, min(cand) AS cand, CAST(max(score) AS INTEGER) AS score FROM k WHERE rk = 1 GROUP BY 1 HAVING count(*) = 1""")
def best_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", F.floor(F.col("o_totalprice") / 50000).alias("band"))
    rows, candidates = orders.where("o_orderkey % 2 = 1"), orders.where("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "cand")
    return match.best_unique(rows, candidates, ["o_custkey"], ["o_orderstatus", "o_orderpriority", "band"], "o_orderkey", "cand")


@query("""
WITH s AS (SELECT user_id, event_type, sum(CAST(round(abs(value)) AS BIGINT)) AS total, max(CAST(round(abs(value)) AS BIGINT)) AS one FROM events GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY total DESC) AS rk, max(one) OVER (PARTITION BY user_id) AS best FROM s)
SELECT user_id, min(event_type) AS event_type, CAST(max(total) AS BIGINT) AS score FROM r WHERE rk = 1 AND best >= 2 GROUP BY 1 HAVING count(*) = 1""")
def scored_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "events").select("user_id", "event_type", F.round(F.abs("value")).cast("long").alias("s"))
    return match.vote(scores, "user_id", "event_type", "s", 2)


_NAMES = "SELECT p_brand, p_partkey, p_name, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g')) AS k, list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM part"


@query(f"""
WITH n AS ({_NAMES}), b AS (SELECT DISTINCT p_brand, target, lower(regexp_replace(target, '[^A-Za-z0-9]+', '', 'g')) AS bk FROM (SELECT p_brand, p_type AS target FROM part UNION ALL SELECT p_brand, left(p_name, -2) FROM part)),
s AS (SELECT p_partkey, target, CASE WHEN k = bk THEN 1.0 WHEN contains(k, bk) OR contains(bk, k) THEN greatest(0.65::DOUBLE, least(len(k), len(bk))::DOUBLE / greatest(len(k), len(bk)))
  ELSE CASE WHEN k = bk THEN 1.0 ELSE 0.0 END END::DOUBLE AS score FROM n JOIN b USING (p_brand))
SELECT p_partkey, target, score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, target) AS rn FROM s WHERE score >= 0.3) WHERE rn = 1""")
def fuzzy_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part the best of its brand's types and shortened names by equality, containment or token overlap of folded names."""
    part = table(spark, sf_dir, "part")
    names = part.select("p_brand", F.col("p_type").alias("target")).unionByName(part.select("p_brand", F.expr("substring(p_name, 1, length(p_name) - 2)").alias("target"))).distinct()
    return similar.fuzzy_top1(part.select("p_partkey", "p_brand", "p_name"), names, ["p_brand"], "p_partkey", "p_name", "target")


@query(f"""
WITH n AS ({_NAMES}), a AS (SELECT p_partkey, unnest(t) AS w FROM n), b AS (SELECT DISTINCT target, unnest(list_distinct(string_split(lower(target), ' '))) AS w FROM (SELECT DISTINCT p_type || ' ' || p_name AS target FROM part)),
s AS (SELECT p_partkey, target, count(*) AS shared FROM a JOIN b USING (w) GROUP BY ALL HAVING count(*) >= 2)
SELECT p_partkey, target, shared FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY shared DESC, target) AS rn FROM s) WHERE rn = 1""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part the type and name, of any part, that shares most tokens with its name."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.concat_ws(" ", "p_type", "p_name").alias("target")).distinct()
    return similar.token_overlap(part.select("p_partkey", "p_name"), names, "p_partkey", "p_name", "target")


@query("""
WITH e AS (SELECT p_brand, p_size, min(p_type) AS found FROM part GROUP BY ALL HAVING count(DISTINCT p_type) = 1)
SELECT p_partkey, found FROM part JOIN e USING (p_brand, p_size)""")
def unique_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part the type of its brand and size, where all parts of these have one."""
    part = table(spark, sf_dir, "part")
    evidence = part.select("p_brand", "p_size", F.col("p_type").alias("found"))
    return match.unique_by_key(part, evidence, ["p_brand", "p_size"], "p_partkey", "found")


@query("""
SELECT p_brand, arg_min(p_name, {'a': NOT regexp_matches(p_name, '^[A-Za-z]*[0-9-][A-Za-z0-9-]*$'), 'b': NOT regexp_matches(p_name, '[+-]'), 'c': len(p_name), 'd': lower(p_name), 'e': p_name}) AS canonical FROM part GROUP BY 1""")
def canonical_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.canonical(table(spark, sf_dir, "part"), ["p_brand"], "p_name")


@query("""
SELECT c_nationkey, arg_min(c_name, {'a': c_mktsegment = 'BUILDING', 'b': c_custkey}) AS c_name FROM customer GROUP BY 1""")
def preferred_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.preferred(table(spark, sf_dir, "customer"), "c_nationkey", "c_name", F.col("c_mktsegment") == "BUILDING", "c_custkey")


_PARTS = "SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS p_type FROM part"


@query(f"""
WITH p AS ({_PARTS}), t AS (SELECT p_brand, p_size // 10 AS x, min(p_type) AS l FROM p WHERE p_partkey % 11 = 0 GROUP BY ALL),
h AS (SELECT DISTINCT p_brand, p_size // 10 AS x FROM p WHERE p_partkey % 11 <> 0)
SELECT p_partkey, p.p_brand, p_size, coalesce(p_type, l) AS p_type FROM p LEFT JOIN t ON p.p_brand = t.p_brand AND p.p_size // 10 = x WHERE p_partkey % 11 <> 0
UNION ALL SELECT p_partkey, p.p_brand, p_size, p_type FROM p ANTI JOIN h ON p.p_brand = h.p_brand AND p.p_size // 10 = x WHERE p_partkey % 11 = 0""")
def template_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("p_type"))
    return match.inherit_from_template(part, F.col("p_partkey") % 11 == 0, F.expr("p_size div 10"), ["p_type"], ["p_brand"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


# ---------------------------------------------------------------- records
@query("""
WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS st, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS pr, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(year(o_orderdate) AS VARCHAR) END AS yr FROM orders),
g AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY -(CAST(st IS NOT NULL AS INTEGER) + CAST(pr IS NOT NULL AS INTEGER) + CAST(yr IS NOT NULL AS INTEGER)),
  -(coalesce(len(st), 0) + coalesce(len(pr), 0) + coalesce(len(yr), 0)), o_orderkey) AS r FROM o)
SELECT o_custkey, arg_min(st, r) FILTER (WHERE st IS NOT NULL) AS st, arg_min(pr, r) FILTER (WHERE pr IS NOT NULL) AS pr, arg_min(yr, r) FILTER (WHERE yr IS NOT NULL) AS yr,
  arg_min(o_orderkey, r) AS o_orderkey, count(*) AS merged_rows FROM g GROUP BY o_custkey""")
def collapse_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer: the fullest order, its blanks filled from the next fullest."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.when(key % 2 == 0, F.col("o_orderstatus")).alias("st"), F.when(key % 3 != 0, F.col("o_orderpriority")).alias("pr"), F.when(key % 5 != 0, F.year("o_orderdate").cast("string")).alias("yr")
    )
    return records.collapse(rows, ["o_custkey"], ["st", "pr", "yr"], "o_orderkey")


@query("""
WITH b AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f FROM orders WHERE o_orderkey % 4 = 0 GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY f) AS k FROM b)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'UNRESOLVED_' || substr(CAST(orders.o_custkey AS VARCHAR), 1, 12) || '_' || lpad(CAST(k AS VARCHAR), 3, '0') END AS ident
FROM orders LEFT JOIN n ON orders.o_custkey = n.o_custkey AND orders.o_orderpriority = n.o_orderpriority""")
def placeholder_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey").cast("string")).alias("ident"))
    return records.placeholder_ids(orders, "o_custkey", ["o_orderpriority"], "ident", "o_orderkey").select("o_orderkey", "ident")


@query("""
WITH f AS (SELECT p_brand, bool_or(p_size > 48) AS has FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN p_size <= 5 AND has THEN NULL ELSE p_type END AS p_type FROM part JOIN f USING (p_brand)""")
def base_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    return records.clear_where_sibling(part, ["p_brand"], F.col("p_size") <= 5, F.col("p_size") > 48, ["p_type"]).select("p_partkey", "p_type")


@query("""
SELECT source, CASE max(CASE WHEN quality = 1 AND toxic = 0 THEN 4 WHEN quality = 1 THEN 3 WHEN toxic = 1 THEN 2 ELSE 1 END) WHEN 4 THEN 'acid' WHEN 3 THEN 'pristine' WHEN 2 THEN 'other' ELSE 'unknown' END AS class
FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def label_class_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "acid").when(F.col("quality") == 1, "pristine").when(F.col("toxic") == 1, "other").otherwise("unknown")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("class", cls)
    return records.lattice_max(docs, ["source"], "class", ["unknown", "other", "pristine", "acid"])


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal texts; texts meet by a digest, so a hot one is one partial row a task."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""
SELECT 'conversations' AS origin, conv_id AS id, count(*) AS n FROM conversations GROUP BY 2 UNION ALL SELECT 'events', user_id, count(*) FROM events GROUP BY 2""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n")).withColumn("origin", F.lit("conversations"))
    b = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n")).withColumn("origin", F.lit("events"))
    return a.unionByName(b)


@query()
def merge_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent merging of partial records within each customer; no SQL."""
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("sid"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("a"), F.year("o_orderdate").cast("string").alias("b"), "o_orderkey")
    return records.greedy_merge(rows, "o_custkey", ["sid"], ["a", "b"], "o_orderkey")


# ---------------------------------------------------------------- measures
@query("""
SELECT l_returnflag, l_linestatus, 'l_quantity' AS metric, median(l_quantity) AS median, count(l_quantity) AS n FROM lineitem GROUP BY 1, 2
UNION ALL SELECT l_returnflag, l_linestatus, 'l_discount', median(l_discount), count(l_discount) FROM lineitem GROUP BY 1, 2""")
def group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.group_medians(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lineitem GROUP BY 1")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = measures.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9])
    return q.select("l_returnflag", *[F.round(F.get("quantiles", F.lit(i)), 6).alias(f"q{p}") for i, p in enumerate((10, 50, 90))])


@query("""
SELECT c_custkey, c_nationkey, CASE WHEN max(c_acctbal) OVER w = min(c_acctbal) OVER w THEN 0.5 ELSE (c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w) END AS c_acctbal
FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.min_max(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_acctbal"], ["c_nationkey"])


@query("""
SELECT c_custkey, CASE WHEN stddev_samp(c_acctbal) OVER w > 0 THEN round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 6) END AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def z_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.z_score(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal", "z", ["c_nationkey"]).select("c_custkey", F.round("z", 6).alias("z"))


_CLASS_WORDS = ["acid", "lead", "table", "tion", "und", "que", "les"]


@query(f"""
WITH l AS (SELECT doc_id, list_filter({_list(_CLASS_WORDS)}, lambda k: contains(lower(text), k)) AS l FROM documents)
SELECT label, count(*) AS n FROM (SELECT unnest(CASE WHEN len(l) > 0 THEN l ELSE ['(none)'] END) AS label FROM l) GROUP BY 1""")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by label, as often as they have labels, and those without any."""
    docs = table(spark, sf_dir, "documents").select(T.keyword_hits(F.lower("text"), _CLASS_WORDS).alias("labels"))
    return records.label_histogram(docs, "labels")


@query("""
SELECT role, sum(CAST(ceil(len(text) / 4.0) AS BIGINT)) AS tokens, round(sum(CAST(ceil(len(text) / 4.0) AS BIGINT)) * CASE role WHEN 'assistant' THEN 0.06 WHEN 'user' THEN 0.03 ELSE 0.01 END / 1000, 6) AS price FROM conversations GROUP BY 1""")
def token_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sums of every role times a price list; a role without a price raises."""
    prices = spark.createDataFrame([("assistant", 0.06), ("user", 0.03), ("system", 0.01)], "role string, usd double")
    turns = table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(F.ceil(F.length("text") / 4.0)).alias("tokens"))
    priced = turns.join(F.broadcast(prices), "role", "left")  # the price list has a row for each role
    usd = F.coalesce("usd", F.raise_error(F.lit("no price for a role")).cast("double"))
    return priced.select("role", "tokens", F.round(F.col("tokens") * usd / 1000, 6).alias("price"))


@query("""
SELECT o_orderpriority, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS "F", arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS "O" FROM orders GROUP BY 1""")
def pivot_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.pivot_last(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderkey", ["F", "O"])


@query("SELECT 'l_quantity' AS term, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, count(*) AS n FROM lineitem")
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = measures.least_squares(table(spark, sf_dir, "lineitem"), {"l_quantity": F.col("l_quantity")}, "l_extendedprice", robust=False)
    return spark.createDataFrame([("l_quantity", round(fit.r2, 6), round(float(fit.beta[1]), 4), round(float(fit.beta[0]), 4), fit.rows)], "term string, r2 double, slope double, intercept double, n long")


@query()
def adjusted_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients with HC3 errors of price on quantity, discount and return flag; checked against numpy in the tests."""
    line = table(spark, sf_dir, "lineitem")
    levels = ["A", "N", "R"]
    terms = {"quantity": F.col("l_quantity"), "discount": F.col("l_discount"), **dict(zip(("flag_N", "flag_R"), measures.one_hot(F.col("l_returnflag"), levels), strict=True))}
    fit = measures.least_squares(line, terms, "l_extendedprice")
    rows = [(n, float(b), float(e), float(b - 1.96 * e), float(b + 1.96 * e)) for n, b, e in zip(fit.names, fit.beta, fit.errors, strict=True)]
    return spark.createDataFrame(rows, "term string, beta double, error double, low double, high double")


@query("SELECT l_returnflag, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return line.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


# ---------------------------------------------------------------- functions
@query("""
WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || ' °C' WHEN 1 THEN p_size || ' K' WHEN 2 THEN p_size || 'K' WHEN 3 THEN CAST(p_size AS VARCHAR) WHEN 4 THEN p_size || ' Celsius' ELSE 'room' END AS raw, p_size FROM part)
SELECT p_partkey, raw, CASE WHEN p_partkey % 6 IN (0, 4) THEN (p_size + 273) || '.15' WHEN p_partkey % 6 = 1 THEN CAST(p_size AS VARCHAR) ELSE raw END AS kelvin FROM r""")
def to_kelvin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperatures of every part's size in five spellings and without a number."""
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, F.concat("p_size", F.lit(" °C"))).when(k == 1, F.concat("p_size", F.lit(" K"))).when(k == 2, F.concat("p_size", F.lit("K"))).when(k == 3, F.col("p_size").cast("string"))
    raw = raw.when(k == 4, F.concat("p_size", F.lit(" Celsius"))).otherwise("room")
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).withColumn("kelvin", T.to_kelvin(F.col("raw")))


@query(r"""
WITH a(acid, mw, usual, pure) AS (VALUES ('HCl', 36.46094::DOUBLE, 1.19::DOUBLE, 1.19::DOUBLE), ('HNO3', 63.01284, 1.41, 1.51), ('H2SO4', 98.079, 1.84, 1.84), ('H3PO4', 97.994, 1.685, 1.885)),
r AS (SELECT p_partkey, p_size, p_partkey % 4 AS k, ['HCl', 'HNO3', 'H2SO4', 'H3PO4'][CAST(p_partkey // 4 % 4 + 1 AS INTEGER)] AS acid FROM part),
v AS (SELECT *, CASE k WHEN 0 THEN p_size * usual * 10.0::DOUBLE / mw WHEN 1 THEN p_size / 100.0::DOUBLE * pure * 1000.0::DOUBLE / mw END AS x FROM r JOIN a USING (acid))
SELECT p_partkey, CASE WHEN k = 2 THEN CAST(p_size AS VARCHAR) WHEN k < 2 THEN regexp_replace(regexp_replace(printf('%.4f', x), '(\.[0-9]*?)0+$', '\1'), '\.$', '') END AS molar,
  CASE k WHEN 0 THEN 'converted_from_wt_percent' WHEN 1 THEN 'converted_from_vv_percent' WHEN 2 THEN 'reported_molar' END AS source FROM v""")
def acid_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentrations of every part's size as weight percent, volume percent, molarity or bare number, of four acids."""
    k = F.col("p_partkey") % 4
    conc = F.when(k == 0, F.concat("p_size", F.lit(" wt%"))).when(k == 1, F.concat("p_size", F.lit("% v/v"))).when(k == 2, F.concat("p_size", F.lit(" M"))).otherwise(F.col("p_size").cast("string"))
    acid = F.get(F.array(*map(F.lit, ("HCl", "HNO3", "H2SO4", "H3PO4"))), F.expr("cast(p_partkey div 4 % 4 as int)"))
    return table(spark, sf_dir, "part").select("p_partkey", T.acid_concentration(conc, acid).alias("_c")).select("p_partkey", "_c.*")


#: Ids, acids and sequences of samples, and the classes that the rules give them.
_SAMPLES = [
    ("BC", None, None, "pristine"), ("BC-HNO3", None, None, "acid"), ("BC-KOH", None, None, "other"), (None, None, None, "unknown"), ("APBC", "HCl", None, "other"), ("qmax", "HCl", None, "other"),
    ("Char (Wang et al., 2010)", "HCl", None, "other"), ("PEI-BC", None, None, "other"), ("S1", "lemon juice", None, "acid"), ("S2", None, "neutralization", "unknown"), ("S3", None, "treated with steam", "other"),
    ("S4", "KOH", None, "other"), ("S5", None, "raw biochar", "pristine"), ("S6", None, None, "unknown"), ("S7", None, "citric acid wash", "acid"), ("EDTA-BC", "HCl", None, "other"),
]


@query("SELECT doc_id, [" + ", ".join(f"'{c}'" for *_, c in _SAMPLES) + f"][CAST(doc_id % {len(_SAMPLES)} + 1 AS INTEGER)] AS class FROM documents")
def sample_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of samples that reach every rule, dealt to the documents by id."""
    at = (F.col("doc_id") % len(_SAMPLES)).cast("int")
    parts = [F.get(F.array(*[F.lit(s[k]).cast("string") for s in _SAMPLES]), at) for k in range(3)]
    return table(spark, sf_dir, "documents").select("doc_id", screening.classify_sample(*parts).alias("class"))


@query("""
SELECT doc_id, CAST(len(list_filter(['acid', 'lead', 'table', 'the', 'und', 'que'], lambda k: contains(lower(text), k))) AS INTEGER) AS hits FROM documents""")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.keyword_hits(F.lower("text"), ["acid", "lead", "table", "the", "und", "que"])).alias("hits"))


@query(r"""
SELECT p_partkey, round(CASE WHEN len(u) = 0 THEN 0 ELSE len(i)::DOUBLE / len(u) END, 9) AS jaccard FROM (
  SELECT p_partkey, list_intersect(a, b) AS i, list_distinct(a || b) AS u FROM (SELECT p_partkey, list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda x: x <> '')) AS b FROM part))""")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.jaccard(T.tokens(F.col("p_name")), T.tokens(F.col("p_type"))), 9).alias("jaccard"))


# ---------------------------------------------------------------- sources, packing, resampling
@query()
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered elements of every page; parsing markup is no SQL, the tests hold it against hand-made pages."""
    return documents.elements(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def pack_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of a conversation packed up to 256 tokens; a sequential fold, no plain SQL."""
    return seam.pack(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 256)


@query("""
SELECT event_type, round(avg(value), 6) AS mean, count(value) AS n, count(DISTINCT user_id) AS clusters FROM events WHERE value IS NOT NULL GROUP BY 1""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by event type with users as clusters; the SQL states what is not resampled."""
    out = resample.cluster_bootstrap(table(spark, sf_dir, "events"), "user_id", ["event_type"], "value", 200)
    return out.select("event_type", F.round("mean", 6).alias("mean"), "n", "clusters")


@query()
def cluster_bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``cluster_bootstrap`` leaves out: interval and replicas, with the default number of replicas; checked by brute force in the tests."""
    return resample.cluster_bootstrap(table(spark, sf_dir, "events"), "user_id", ["event_type"], "value")


@query("""
SELECT a.source_group, a.n AS left_n, b.n AS right_n, round(a.n::DOUBLE / b.n, 6) AS ratio FROM (SELECT source AS source_group, count(*) AS n FROM documents WHERE n_chars % 2 = 0 GROUP BY 1) a
JOIN (SELECT source AS source_group, count(*) AS n FROM documents WHERE n_chars % 2 = 1 GROUP BY 1) b USING (source_group)""")
def grouped_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner join of two aggregates of one table, aggregated in one pass."""
    docs = table(spark, sf_dir, "documents")
    even = F.count(F.when(F.col("n_chars") % 2 == 0, 1))
    odd = F.count(F.when(F.col("n_chars") % 2 == 1, 1))
    out = docs.groupBy(F.col("source").alias("source_group")).agg(even.alias("left_n"), odd.alias("right_n")).where("left_n > 0 and right_n > 0")
    return out.withColumn("ratio", F.round(F.col("left_n") / F.col("right_n"), 6))
