"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are put in a reproducible shuffled order, as often over as
the mix may repeat them. A copy's virtual finish time is its source's words so far
divided by the source's target. All copies are ordered by that time over all sources
and the order is cut at the total budget, so each source comes within one document
of its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.storage import stage_table

#: Rows aimed at in one bucket of a source's order, and words' worth of rows in one range of finish times.
BUCKET_ROWS = 20_000
RANGE_ROWS = 2_000
_ORDER = ["_key", "_id", "_size", "_tie"]
_PLACE = ["_src", *_ORDER]


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    marked = F.regexp_replace(text, r"[^ \t-\r]+", "a")
    return F.coalesce(F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def _shuffle_key(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id, or of the text's where there is none: the order of a source's documents."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))), 1, 15), 16, 10).cast("long")


def _text_tie(text: Column) -> Column:
    """60 bits of the text's MD5, which order texts of one id and size."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], budget: float, repeats: int) -> DataFrame:
    """Target words of every source: ``_src, source_size, target`` from ``_src, source_size``.

    Sources by code point (null last) weigh ``weights`` in turn and share ``budget`` times
    all words; no target exceeds ``repeats`` times its source, the excess being
    shared again by weight. One row for each source, so windows over all of them are small.
    """
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy("_src")) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    full = F.col("source_size") * float(repeats)
    by_fill = Window.orderBy((full / F.col("_w")), "_src")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("_w", weigh)
    out = out.withColumn("_all", F.sum("source_size").over(every)).withColumn("_weights", F.sum("_w").over(every))
    # with the sources that fill up first taken out, what each unit of weight gets
    out = out.withColumn("_taken", F.coalesce(F.sum(full).over(before), F.lit(0.0))).withColumn("_gone", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    out = out.withColumn("_level", (F.col("_all") * float(budget) - F.col("_taken")) / (F.col("_weights") - F.col("_gone")))
    out = out.withColumn("_open", F.col("_level") * F.col("_w") < full)
    level = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("_final", level)
    target = F.when(F.col("_final").isNull(), full).otherwise(F.least(full, F.col("_final") * F.col("_w")))
    return out.select("_src", "source_size", target.alias("target"))


def schedule(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, repeats: int = 2, carry: bool = False,
) -> DataFrame:
    """Every document with what the mix takes of it.

    Columns: ``_id, _size, _src, source_size, target, _finish`` (one virtual finish time
    for each pass over the source) and ``_takes`` (words taken in each pass); with
    ``carry`` the whole row of ``docs`` as the struct ``_row`` as well. The document at the cut is taken in part,
    so the mix holds exactly the budget (rounded down).

    Null and wordless texts have size 0 and nothing is taken of them. A null source is
    a source of its own, the last. Ids are numbers or strings; documents of one id are ordered by size and their text's hash, those
    without an id by that hash; equal rows are interchangeable. An empty table has an empty result.
    """
    spark = docs.sparkSession
    src = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    keyed = docs.select(*([F.struct("*").alias("_row")] if carry else []), F.col(id_col).alias("_id"), word_count(F.col(text_col)).alias("_size"), src.alias("_src"), _shuffle_key(F.col(id_col), F.col(text_col).cast("string")).alias("_key"), _text_tie(F.col(text_col).cast("string")).alias("_tie"))
    narrow = stage_table(keyed.select("_id", "_size", "_src", "_key", "_tie"), "sizes")
    rows = narrow.count()
    bits = max(5, (rows // BUCKET_ROWS).bit_length() + 2)
    bucket = F.shiftright("_key", 60 - bits).alias("_bucket")
    buckets = narrow.groupBy("_src", bucket).agg(F.sum("_size").alias("_words"))
    ahead = F.sum("_words").over(Window.partitionBy("_src").orderBy("_bucket")) - F.col("_words")
    targets = source_targets(buckets.groupBy("_src").agg(F.sum("_words").alias("source_size")), weights, budget, repeats)
    ahead = stage_table(buckets.select("_src", "_bucket", ahead.alias("_ahead")).join(targets, "_src"), "ahead")

    def timed(table: DataFrame) -> DataFrame:
        # (source, bucket) spreads a hot source over many tasks; the join reuses the window's partitioning
        table = table.withColumn("_bucket", F.shiftright("_key", 60 - bits))
        so_far = F.sum("_size").over(Window.partitionBy("_src", "_bucket").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0))
        table = table.withColumn("_so_far", so_far).join(ahead, ["_src", "_bucket"])
        finish = [(F.lit(float(p)) * F.col("source_size") + F.col("_ahead") + F.col("_so_far")) / F.col("target") for p in range(repeats)]
        return table.withColumn("_finish", F.array(*[F.when(F.col("_size") > 0, f) for f in finish]))

    # the global order is sorted by ranges of finish time; only the range in which the budget ends is sorted within
    copies = timed(narrow).where("_size > 0").select("_id", "_size", "_src", "_key", "_tie", F.posexplode("_finish").alias("_pass", "_time"))
    ranges = max(16, rows // RANGE_ROWS)
    copies = copies.withColumn("_range", F.floor(F.col("_time") * ranges))
    total = narrow.agg(F.sum("_size")).first()[0] or 0
    left = int(total * budget)
    order = ["_time", "_src", "_key", "_id", "_size", "_tie", "_pass"]
    until = F.sum("_words").over(Window.orderBy("_range"))
    edge = copies.groupBy("_range").agg(F.sum("_size").alias("_words")).withColumn("_until", until).where(F.col("_until") > left).orderBy("_range").first()
    cut = None
    if edge is not None:
        left -= edge["_until"] - edge["_words"]
        inside = copies.where(F.col("_range") == edge["_range"]).withColumn("_until", F.sum("_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        cut = inside.where(F.col("_until") > left).orderBy(*order).first()
    out = timed(keyed if carry else narrow)
    takes = []
    for p in range(repeats):
        if cut is None:
            takes.append(F.col("_size"))
            continue
        row = F.struct(F.col("_finish")[p].alias("a"), F.col("_src").alias("b"), F.col("_key").alias("c"), F.col("_id").alias("d"), F.col("_size").alias("e"), F.col("_tie").alias("f"), F.lit(p).alias("g"))
        at = F.struct(F.lit(cut["_time"]).alias("a"), F.lit(cut["_src"]).alias("b"), F.lit(cut["_key"]).alias("c"), F.lit(cut["_id"]).cast(copies.schema["_id"].dataType).alias("d"), F.lit(cut["_size"]).cast("long").alias("e"), F.lit(cut["_tie"]).cast("long").alias("f"), F.lit(cut["_pass"]).alias("g"))
        part = left - (cut["_until"] - cut["_size"])
        takes.append(F.when(F.col("_finish")[p].isNull() | (row > at), 0).when(row < at, F.col("_size")).otherwise(F.lit(part)).cast("long"))
    return out.withColumn("_takes", F.array(*takes)).drop("_bucket", "_so_far", "_ahead")


def mix(docs: DataFrame, text_col: str = "text", **settings: object) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row for each copy taken, in the global order of virtual finish times.

    The text of the copy at the cut ends after the words taken. Settings are those of ``schedule``.
    """
    taken = schedule(docs, text_col=text_col, carry=True, **settings)
    copies = taken.select("_row", *_PLACE, F.posexplode(F.arrays_zip(F.col("_finish").alias("f"), F.col("_takes").alias("t"))).alias("_pass", "_copy")).where("_copy.t > 0")
    text = F.col("_row")[text_col]
    begun = F.array_join(F.slice(F.split(text, r"(?<=[^ \t-\r])(?=[ \t-\r])"), F.lit(1), F.col("_copy.t").cast("int")), "")
    parts = F.when(F.col("_copy.t") < F.col("_size"), begun).otherwise(text)
    order = [F.col("_copy.f"), *map(F.col, _PLACE), F.col("_pass")]  # the order of the cut: equal times do not differ between runs
    return copies.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("_row").withField(text_col, parts).alias("_row")).select("_row.*")


def op1_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: weights 5, 2, 1 in turn, 150 percent of all words, at most two passes."""
    found = schedule(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    taken = F.aggregate("_takes", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS key,
    CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS tie
  FROM documents
), s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT *, CAST([5.0, 2.0, 1.0][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS DOUBLE) AS w, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
f AS (SELECT *, sum(w) OVER () AS weights,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    coalesce(sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM w),
l AS (SELECT *, (total * 1.5::DOUBLE - before) / (weights - gone) AS level FROM f),
m AS (SELECT min(level) AS final FROM (SELECT level FROM l WHERE level * w < source_size * 2.0::DOUBLE ORDER BY source_size * 2.0::DOUBLE / w, src LIMIT 1)),
t AS (SELECT src, source_size, CASE WHEN final IS NULL THEN source_size * 2.0::DOUBLE ELSE least(source_size * 2.0::DOUBLE, final * w) END AS target, CAST(floor(total * 1.5::DOUBLE) AS BIGINT) AS budget FROM l, m),
c AS (SELECT d.*, source_size, target, budget, sum(size) OVER (PARTITION BY src ORDER BY key, doc_id NULLS FIRST, size, tie ROWS UNBOUNDED PRECEDING) AS so_far FROM d JOIN t USING (src)),
p AS (SELECT *, unnest([0, 1]) AS pass FROM c WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY (pass::DOUBLE * source_size + so_far) / target, src, key, doc_id NULLS FIRST, size, tie, pass ROWS UNBOUNDED PRECEDING) AS until FROM p),
k AS (SELECT src, key, doc_id, size, so_far, sum(greatest(0, least(size, budget - (until - size)))) AS taken FROM o GROUP BY ALL)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM c LEFT JOIN k ON c.src = k.src AND c.key = k.key AND c.doc_id IS NOT DISTINCT FROM k.doc_id AND c.size = k.size AND c.so_far = k.so_far
"""
