"""Target-distribution importance resampling over bucket-partitioned postings.

Every text becomes postings (bucket, document, count) of its hashed word n-grams. The
bucket totals of both corpora are summed first, from each text alone. Then postings are
shuffled by ranges of buckets, in packed blocks; each range meets the totals that both
corpora have there, computes its buckets' gains and turns its postings into
contributions, one for each document, which are reduced by document. A range's postings
lie in as many slots as the corpus needs, each with the range's totals, so a bucket that
all documents share is no one task's work. The draw is by the greatest of the
weights with Gumbel noise from the document's id.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.sharding import number_rows
from marlstone.llm.shingles import raw_bytes, text_slices
from marlstone.llm.storage import small_batches, stage_table

#: Ranges of buckets, slots of a range at least, and documents for which a range gets one slot.
RANGES, LEAST_SLOTS, SLOT_DOCS = 16, 64, 20_000
SLICE = 1_000_000
#: Bytes of a word that are hashed for all words at once; longer ones go on alone.
_TOGETHER = 48
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True
_SPACE = 32


def _crc_table() -> np.ndarray:
    """CRC-32 of every byte, by the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def _crc_step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _TABLE[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def _extend(state: np.ndarray, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states (inverted checksums) after each word's bytes."""
    state = state.copy()
    order = np.argsort(-lengths, kind="stable")
    begins, lengths, by_length = begins[order], lengths[order], state[order]
    for k in range(min(_TOGETHER, int(lengths[0])) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -k, side="left"))  # words longer than k
        by_length[:live] = _crc_step(by_length[:live], data[begins[:live] + k].astype(np.uint32))
    for i in range(int(np.searchsorted(-lengths, -_TOGETHER, side="left"))):
        rest = data[begins[i] + _TOGETHER : begins[i] + lengths[i]].tobytes()
        by_length[i] = zlib.crc32(rest, int(by_length[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    state[order] = by_length
    return state


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int, most: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every run of 1 to ``most`` words, and the number of words of each text."""
    data = _LOWER[data]
    inside = _INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]  # a text starts a word even where the one before ends without a gap
    begins = np.flatnonzero(first)
    per_text = np.diff(np.searchsorted(begins, offsets))
    text = np.repeat(np.arange(len(per_text)), per_text)
    ends = np.searchsorted(np.flatnonzero(inside), begins)
    lengths = np.diff(np.append(ends, int(inside.sum())))
    found, owners = [], []
    state = np.full(len(begins), 0xFFFFFFFF, np.uint32)
    for n in range(1, most + 1):
        if n > 1:
            # the run goes on with the next word of the same text
            goes_on = text[: len(text) - n + 1] == text[n - 1 :]
            state = _crc_step(state[: len(goes_on)], np.uint32(_SPACE))
        else:
            goes_on = np.ones(len(begins), bool)
        state = _extend(state, data, begins[n - 1 :], lengths[n - 1 :])
        found.append(((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)[goes_on])
        owners.append(text[: len(goes_on)][goes_on])
    return np.concatenate(found), np.concatenate(owners), per_text


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        column = batch.column(text).cast(pa.string())
        for start, stop in text_slices(column, SLICE):
            yield batch.slice(start, stop - start), column.slice(start, stop - start)


def _count(buckets: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's features in each bucket: one row for each bucket that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in _slices(batches, 0):
            total += np.bincount(ngram_buckets(*raw_bytes(texts), buckets, most)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    return run


def bucket_totals(texts: DataFrame, text_col: str, buckets: int, most: int) -> DataFrame:
    """``bucket, n``: features of all texts in each bucket that has any."""
    counted = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(buckets, most), "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _post(buckets: int, most: int, slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``doc_id, mark, text`` to blocks ``range, slot, ids, documents, postings``: one for each range of buckets and slice of texts.

    Documents that a block has postings of, and in the first range all without any, stand in it with
    their mark, number of features and words; postings are bucket, place in the block and count, by bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches, 2):
            bucket, owner, words = ngram_buckets(*raw_bytes(texts), buckets, most)
            features = np.bincount(owner, minlength=len(words))
            key, counts = np.unique(bucket * len(words) + owner, return_counts=True)
            bucket, owner = key // max(1, len(words)), key % max(1, len(words))
            marks = batch.column(1).to_numpy(zero_copy_only=False)
            bounds = np.searchsorted(bucket, [-(-buckets * r // RANGES) for r in range(RANGES + 1)])
            # the first range of a document counts it as a row
            home = np.full(len(words), RANGES)
            for r in reversed(range(RANGES)):
                home[owner[bounds[r] : bounds[r + 1]]] = r
            home[home == RANGES] = 0
            slot = int(zlib.crc32(marks.tobytes())) % slots
            ranges, ids, documents, postings = [], [], [], []
            for r in range(RANGES):
                here = slice(bounds[r], bounds[r + 1])
                docs = np.union1d(owner[here], np.flatnonzero(home == r))
                if not len(docs):
                    continue
                ranges.append(r)
                ids.append(batch.column(0).take(pa.array(docs)).to_pylist())
                documents.append(np.stack([marks[docs], features[docs], words[docs], home[docs] == r]).astype(np.int64).tobytes())
                postings.append(np.stack([bucket[here], np.searchsorted(docs, owner[here]), counts[here]]).astype(np.uint32).tobytes())
            columns = [pa.array(ranges, pa.int32()), pa.array([slot] * len(ranges), pa.int32()), pa.array(ids, pa.list_(batch.schema.field(0).type)), pa.array(documents, pa.binary()), pa.array(postings, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["range", "slot", "ids", "documents", "postings"])

    return run


def gains(s: np.ndarray, all_s: int, t: np.ndarray, all_t: int, buckets: int) -> np.ndarray:
    """What one feature of each bucket adds: 1000 times the log of the ratio of smoothed shares, rounded down."""
    s, t = s.astype(np.float64), t.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * float(all_s + buckets) / ((s + 1) * float(all_t + buckets)))).astype(np.int64)


def _contribute(buckets: int, all_s: int, all_t: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks sorted by range and slot, the totals of both corpora (``ids`` null) before the postings, to one contribution for each document of a block. One block is held at a time."""
    names = ["doc_id", "mark", "n_features", "n_words", "gain", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, gain = None, np.zeros(0, np.int64)
        for batch in batches:
            for k in range(len(batch)):
                place = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                postings = batch.column(4)[k].as_py()
                if not batch.column(2)[k].is_valid:
                    bucket, s, t = np.frombuffer(postings, np.int64).reshape(3, -1)
                    gain = np.zeros(buckets, np.int64)
                    gain[bucket] = gains(s, all_s, t, all_t, buckets)
                    of = place
                    continue
                if of != place:
                    raise ValueError(f"postings of {place} without totals")
                marks, features, words, home = np.frombuffer(batch.column(3)[k].as_py(), np.int64).reshape(4, -1)
                bucket, doc, count = np.frombuffer(postings, np.uint32).reshape(3, -1)
                each = np.zeros(len(marks), np.int64)
                np.add.at(each, doc, gain[bucket] * count)
                yield pa.RecordBatch.from_arrays([batch.column(2)[k].values.cast(id_type), *(pa.array(c) for c in (marks, features, words, each, home))], names)

    return run


def _pack(totals: DataFrame, slots: int, id_type: str, buckets: int) -> DataFrame:
    """Totals ``bucket, s, t`` as rows of the blocks' schema: one for each range and slot."""

    def pack(rows: pa.Table) -> pa.Table:
        values = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("bucket", "s", "t")])
        return pa.table([pa.array([rows["range"][0].as_py()], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["range", "postings"])

    # fewer rows than buckets, in as many groups as ranges
    ranged = totals.withColumn("range", F.floor(F.col("bucket") * RANGES / buckets).cast("int"))
    packed = ranged.groupBy("range").applyInArrow(pack, "range int, postings binary")
    return packed.select("range", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(None).cast(f"array<{id_type}>").alias("ids"), F.lit(None).cast("binary").alias("documents"), "postings")


def importance_weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000, most: int = 2, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``doc_id, n_features, n_words, weight`` for each row of ``docs``: the floored mean gain of its features towards ``target``.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased; features are all runs of 1 to ``most`` words
    joined by one space, repeats counted; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``.
    Ids are whole numbers, or anything else as a string.
    Null, empty and wordless texts have no features and weight 0. Rows of one id are told apart by a
    64-bit hash of their text and their counts; equal rows come out as often as they went in; rows
    without an id count like others. Either table may be empty; other columns are ignored. Totals
    per bucket, the only thing every slot of a range gets, are at most ``buckets`` rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col(text_col).cast("string")
    id_type = dict(docs.dtypes)[id_col] if dict(docs.dtypes)[id_col] in ("bigint", "int") else "string"
    source = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    s, t = (bucket_totals(d, c, buckets, most) for d, c in ((docs, text_col), (target, target_col)))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    totals = every.join(s.select("bucket", F.col("n").alias("s")), "bucket", "left").join(t.select("bucket", F.col("n").alias("t")), "bucket", "left")
    totals = stage_table(totals.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "totals")
    sums = totals.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    slots = max(LEAST_SLOTS, docs.count() // SLOT_DOCS)
    blocks = source.mapInArrow(_post(buckets, most, slots), f"range int, slot int, ids array<{id_type}>, documents binary, postings binary")
    both = _pack(totals, slots, id_type, buckets).unionByName(blocks)
    # the totals of a range come before its postings
    dealt = both.repartition("range", "slot").sortWithinPartitions("range", "slot", F.col("ids").isNotNull())
    arrow_id = {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())
    parts = dealt.mapInArrow(_contribute(buckets, int(sums["s"]), int(sums["t"]), arrow_id), f"doc_id {id_type}, mark long, n_features long, n_words long, gain long, copies long")
    reduced = parts.groupBy("doc_id", "mark", "n_features", "n_words").agg(F.sum("gain").alias("gain"), F.sum("copies").cast("int").alias("copies"))
    # equal rows have equal sums, so the quotient by their number is whole; the mean rounds down
    mean = F.expr("CASE WHEN n_features > 0 THEN (gain div copies - pmod(gain div copies, n_features)) div n_features ELSE 0L END")
    return reduced.select("doc_id", "n_features", "n_words", mean.alias("weight"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise from the id: 1000 times a standard Gumbel value, rounded down. An id that is null has the noise of an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, **settings: object) -> DataFrame:
    """``importance_weights`` with ``score`` (weight and noise) and ``rank``: of the N rows with ``least_words`` words or more, the floor of ``percent`` * N / 100 greatest scores are drawn.

    Ties go to the smaller id (null first), then to fewer features; rank is null for rows not drawn.
    """
    weighed = importance_weights(docs, target, **settings)
    weighed = stage_table(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weights")
    able = weighed.where(F.col("n_words") >= least_words)
    rows = able.count()
    drawn = rows * percent // 100
    ranked = number_rows(able.withColumn("_down", -F.col("score")), ["_down", "doc_id", "n_features", "weight"], rows)
    ranked = ranked.select("doc_id", "n_features", "n_words", "weight", "score", F.when(F.col("_row") < drawn, F.col("_row") + 1).cast("long").alias("rank"))
    rest = weighed.where(F.col("n_words") < least_words).select("doc_id", "n_features", "n_words", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


def op11_postings_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed towards the benchmark, a quarter of those of 20 words or more drawn."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs.select("doc_id", "text"), target).drop("n_words")


OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range AS i, range AS c, 0 AS step FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
counted AS (SELECT side, id, f, count(*) AS n FROM features GROUP BY ALL),
hashed AS (SELECT f, CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS BIGINT) % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), tab),
postings AS (SELECT side, id, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM postings GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM totals) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM totals) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM totals),
weighed AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight FROM postings JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weighed USING (id) WHERE side = 0),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
