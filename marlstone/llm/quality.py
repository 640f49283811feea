"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics come from the bytes of whole texts, vectorised in numpy. Trees are grown
on binned statistics from histograms of gradients, on a bounded sample of labelled
documents, and are flattened into arrays: scoring moves all documents of a batch
down a tree one level at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shingles import raw_bytes, text_parts, text_slices, word_hashes
from marlstone.llm.storage import small_batches

#: Most labelled documents that are fitted: those of the least hash of the id.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 60, 4, 64, 0.2, 10, 1.0
SLICE = 500_000

_KINDS = np.full(256, 0, np.int32)  # 0: bytes of characters outside ASCII
for _kind, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".", b",;:'\"()-", b"!?", b"|", b"#$%&*@^~_=+<>/\\[]{}`"), 1):
    _KINDS[list(_chars)] = _kind
_KINDS[list(range(9))] = 11
_KINDS[14:32] = 11
_KINDS[127] = 11
FEATURES = [
    "log_words", "word_bytes", "word_bytes_sd", "distinct", "repeats", "other", "lower", "upper", "digits", "blanks", "breaks",
    "stops", "marks", "shouts", "bars", "symbols", "controls", "upper_words", "symbol_words", "words_a_line", "words_a_stop", "longest",
]


def _sums(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What statistics are made of, a row for each text, and the hashes of all words with their texts.

    Columns: bytes of each of the 12 kinds, words, their bytes, squares of these, distinct words,
    words that repeat the one before, words in capitals, words ending in a symbol, longest word.
    """
    n = len(offsets) - 1
    out = np.zeros((n, 20))
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    kinds = _KINDS[data]
    out[:, :12] = np.bincount(owner * np.int32(12) + kinds, minlength=n * 12).reshape(n, 12)
    words, per_text = word_hashes(data, offsets)
    by = np.repeat(np.arange(n, dtype=np.int32), per_text)
    if not len(words):
        return out, words, by
    space = (kinds == 4) | (kinds == 5)
    first = ~space
    first[1:] &= space[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = ~space[edges]
    starts = np.flatnonzero(first)
    last = ~space
    last[:-1] &= space[1:]
    last[edges - 1] = ~space[edges - 1]
    ends = np.flatnonzero(last)
    lengths = (ends - starts + 1).astype(float)
    order = np.lexsort((words, by))
    w, b = words[order], by[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (b[1:] != b[:-1])
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (by[1:] == by[:-1])
    second, final = kinds[np.minimum(starts + 1, ends)], kinds[ends]
    shouted = (kinds[starts] == 2) & (second == 2) & (ends > starts)
    out[:, 12] = per_text
    for at, value in enumerate((lengths, lengths**2), 13):
        out[:, at] = np.bincount(by, value, n)
    out[:, 15] = np.bincount(b, fresh, n)
    for at, value in enumerate((same, shouted, final >= 8), 16):
        out[:, at] = np.bincount(by, value, n)
    has = per_text > 0
    out[has, 19] = np.maximum.reduceat(lengths, (np.cumsum(per_text) - per_text)[has])
    return out, words, by


def _long_sums(data: np.ndarray, part: int) -> np.ndarray:
    """The sums of one very long text, by parts; only its distinct words are held."""
    out, known, before = np.zeros((1, 20)), np.zeros(0, np.uint64), None
    for begin, end in text_parts(data, part):
        own, words, _ = _sums(data[begin:end], np.array([0, end - begin]))
        longest = max(out[0, 19], own[0, 19])
        out += own
        out[0, 19] = longest
        if len(words):
            out[0, 16] += before is not None and words[0] == before
            before = words[-1]
            known = np.union1d(known, words)
    out[0, 15] = len(known)
    return out


def statistics(data: np.ndarray, offsets: np.ndarray, part: int = 4 * SLICE) -> np.ndarray:
    """A row of ``FEATURES`` for each text; all zeros for an empty one. A single text of more than ``part`` bytes is taken by parts."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, len(FEATURES)))
    sums = _long_sums(data, part // 4) if n == 1 and len(data) > part else _sums(data, offsets)[0]
    sizes, counts, per_text = np.diff(offsets), sums[:, :12], sums[:, 12]
    total = np.maximum(per_text, 1)
    mean = sums[:, 13] / total
    share = counts / np.maximum(sizes, 1)[:, None]
    out = np.column_stack([
        np.log1p(per_text), mean, np.sqrt(np.maximum(sums[:, 14] / total - mean**2, 0)), sums[:, 15] / total, sums[:, 16] / total, share,
        sums[:, 17] / total, sums[:, 18] / total, per_text / (counts[:, 5] + 1), per_text / (counts[:, 6] + 1), np.log1p(sums[:, 19]),
    ])
    out[sizes == 0] = 0
    return out


@dataclass
class Forest:
    """Trees flattened end to end: a leaf points to itself on both sides."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        logit = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.low[node], self.high[node])
            logit += self.value[node]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosted trees on the logistic loss. With one class only, or no rows, the score is that class's (or 0.5)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    feature, threshold, low, high, value, roots = [], [], [], [], [], []

    def node() -> int:
        feature.append(0), threshold.append(np.inf), low.append(len(low)), high.append(len(high)), value.append(0.0)
        return len(value) - 1

    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
        logit = np.full(len(y), base)
        wide = binned + np.arange(x.shape[1]) * BINS
        for _ in range(trees):
            p = 1 / (1 + np.exp(-logit))
            grad, hess = p - y, p * (1 - p)
            roots.append(node())
            level = [(roots[-1], np.arange(len(y)))]
            for d in range(depth + 1):
                following = []
                for at, rows in level:
                    g, h = grad[rows].sum(), hess[rows].sum()
                    best = None
                    if d < depth and len(rows) >= 2 * LEAST:
                        flat = wide[rows].ravel()
                        size = x.shape[1] * BINS
                        hist = [np.bincount(flat, np.repeat(v, x.shape[1]), size).reshape(-1, BINS).cumsum(axis=1) for v in (grad[rows], hess[rows], np.ones(len(rows)))]
                        gl, hl, nl = hist
                        gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
                        gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = -np.inf
                        f, k = np.unravel_index(int(np.argmax(gain)), gain.shape)
                        if gain[f, k] > 1e-6 and k < len(cuts[f]):
                            best = (int(f), int(k))
                    if best is None:
                        value[at] = -RATE * g / (h + RIDGE)
                        logit[rows] += value[at]
                        continue
                    f, k = best
                    feature[at], threshold[at] = f, float(cuts[f][k])
                    low[at], high[at] = node(), node()
                    left = binned[rows, f] <= k
                    following += [(low[at], rows[left]), (high[at], rows[~left])]
                level = following
    if not roots:
        roots.append(node())
    return Forest(base, np.array(roots), np.array(feature), np.array(threshold), np.array(low), np.array(high), np.array(value), depth)


def _per_text(column: pa.Array, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    column = column.cast(pa.string())
    parts = [make(statistics(*raw_bytes(column.slice(a, b - a)))) for a, b in text_slices(column, SLICE)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            rows = _per_text(batch.column(2), lambda s: s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def held_out(doc_id: str = "doc_id"):
    """The fold that is never learned from: crc32 of the id as text leaves 1 when divided by 3 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = FIT_ROWS) -> Forest:
    """A forest fitted on at most ``most`` labelled documents outside the held-out fold.

    Labels other than 0 and 1 are left out; of several for one id the mean decides
    (a half is 0). Of several texts of one id the one of least statistics is taken.
    """
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col(label_col).cast("double").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.floor(F.avg("label") + 0.4999999).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most ``most`` rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")
    rows = texts.mapInArrow(_measure, f"doc_id {dict(texts.dtypes)['doc_id']}, label double, x array<double>").groupBy("doc_id", "label").agg(F.min("x").alias("x"))
    table = rows.toArrow().sort_by("doc_id")
    x = np.array(table["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, np.array(table["label"].to_pylist(), float))


def score_documents(docs: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts have the statistics of an empty text and a score like any
    other. Rows repeat as they come; other columns are ignored; an empty table has
    an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                score = _per_text(batch.column(2), forest.scores)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is 0.5 or more."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.filter(pa.array(_per_text(batch.column(at), forest.scores) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op5_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from ``labels.quality`` outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
