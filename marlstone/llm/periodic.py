"""Periodic runs of words, by bit-parallel lags.

A text's words get numbers, and bit ``j`` of all numbers forms the big integer of plane
``j``. For a lag ``q`` each plane is XORed with itself shifted by ``q`` and the results are
ORed: bit ``i`` is 0 where word ``i`` equals word ``i + q``. A zero stretch of length ``L`` is a
stretch of ``L + q`` words with period ``q``; stretches that are long enough are isolated by
ANDing the complement with itself under doubling shifts.

Which lags are tried: all small ones, and of the larger those that a run can have. A run of
period ``q`` in ``[2b, 4b)`` holds in its first period a whole aligned block of ``b`` words,
which recurs ``q`` words later. Blocks are compared exactly, by ranks of word sequences of
doubled length. A pair of blocks inside one run of a period of at most ``b`` gives no lag: by
the theorem of Fine and Wilf what has both periods has their common divisor too.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shingles import text_slices
from marlstone.llm.storage import small_batches

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words that a run has at least, whatever its period.
LEAST = 12
#: Lags below this are all tried; a power of two.
SMALL = 16
SLICE = 1_000_000

Run = tuple[int, int, int]
Prepare = Callable[[object, list[str]], list[str]]


def _planes(ids: np.ndarray, distinct: int) -> list[int]:
    """Bit planes of the numbers as big integers, word ``i`` at bit ``i``."""
    return [int.from_bytes(np.packbits((ids >> j) & 1, bitorder="little").tobytes(), "little") for j in range(max(1, (distinct - 1).bit_length()))]


def _stretches(planes: list[int], n: int, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """Begin and length of each longest stretch of at least ``least`` places ``i`` at which word ``i`` equals word ``i + lag``."""
    unlike = 0
    for plane in planes:
        unlike |= plane ^ (plane >> lag)
    alike = ~unlike & ((1 << (n - lag)) - 1)
    have = 1
    while have < least and alike:
        step = min(have, least - have)
        alike &= alike >> step
        have += step
    if not alike:
        return
    bits = np.zeros(n - lag + 2, np.int8)  # a zero on either side
    bits[1:-1] = np.unpackbits(np.frombuffer(alike.to_bytes((n - lag + 7) // 8, "little"), np.uint8), bitorder="little")[: n - lag]
    change = np.flatnonzero(np.diff(bits))
    for begin, end in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        yield begin, end - begin + least - 1


def _runs_of_lag(planes: list[int], n: int, lag: int, found: list[Run]) -> list[Run]:
    """Runs whose smallest period is ``lag``; those of all smaller lags are in ``found``."""
    stretches = list(_stretches(planes, n, lag, max(LEAST - lag, lag)))
    inside = [(s, s + length) for s, length, q in found if lag % q == 0] if stretches else []
    return [(begin, length + lag, lag) for begin, length in stretches if not any(s <= begin and begin + length + lag <= e for s, e in inside)]


def _lags(ranks: np.ndarray, b: int, found: list[Run]) -> list[int]:
    """Lags in ``[2b, 4b)`` at which an aligned block of ``b`` words recurs, but for pairs inside one run of a period up to ``b``. ``ranks`` numbers the sequences of ``b`` words."""
    m = len(ranks)
    key = ranks.astype(np.int64) * (m + 4 * b) + np.arange(m)
    key.sort()
    at = np.arange(0, m, b)
    base = ranks[at].astype(np.int64) * (m + 4 * b) + at
    low, high = np.searchsorted(key, base + 2 * b), np.searchsorted(key, base + 4 * b)
    counts = high - low
    if not counts.sum():
        return []
    pick = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    block = np.repeat(at, counts)
    lag = key[pick] - np.repeat(base, counts)
    small = sorted((s, s + length) for s, length, q in found if q <= b)
    if small:
        starts = np.array([s for s, _ in small])
        reach = np.append(-1, np.maximum.accumulate([e for _, e in small]))
        lag = lag[reach[np.searchsorted(starts, block, side="right")] < block + lag + b]
    return np.unique(lag).tolist()


def periodic_runs_of(words: list[str]) -> list[Run]:
    """``(start, length, period)`` of every run, by start and period.

    A run is a stretch of consecutive words with smallest period ``q``, of ``max(12, 2q)`` words
    or more, which neither neighbouring word continues with that period.
    """
    n = len(words)
    # a run repeats six words at least: without that there is none
    if n < LEAST or len(set(zip(*(words[k:] for k in range(6)), strict=False))) == n - 5:
        return []
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    planes = _planes(ids, len(numbers))
    found: list[Run] = []
    for lag in range(1, min(SMALL - 1, n // 2) + 1):
        found += _runs_of_lag(planes, n, lag, found)
    ranks, length = ids, 1
    while 4 * length <= n:
        # sequences of twice the length are pairs of sequences
        pairs = ranks[:-length] * (int(ranks.max()) + 1) + ranks[length:]
        values, ranks = np.unique(pairs, return_inverse=True)
        length *= 2
        if len(values) == len(ranks):
            break
        if length >= SMALL // 2:
            for lag in _lags(ranks, length, found):
                if 2 * lag <= n:
                    found += _runs_of_lag(planes, n, lag, found)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[Run]) -> str:
    """The words joined by one space, of each run only its first period."""
    if not runs:
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _search(prepare: Prepare | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            for start, stop in text_slices(texts, SLICE):
                ids = batch.column(0).slice(start, stop - start)
                counts, runs, kept = [], [], []
                for doc_id, text in zip(ids.to_pylist(), texts.slice(start, stop - start).to_pylist(), strict=True):
                    words = _WORD.findall(text or "")
                    if prepare is not None:
                        words = prepare(doc_id, words)
                    found = periodic_runs_of(words)
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    kept.append(collapsed(words, found))
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Prepare | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row: its runs by start and period, and the text with only the first period of each run, words joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0. ``prepare`` takes an id and the words and
    returns those to search instead. Null, empty and wordless texts have no words, no
    runs and an empty text; rows of one id, equal rows and rows without an id stand each for
    themselves; other columns are ignored; an empty table has an empty result.
    Nothing is shuffled. One text is searched in one task, in memory
    proportional to it. Lowers the session's bound on Arrow batches (``small_batches``).
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {dict(source.dtypes)['doc_id']}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return source.mapInArrow(_search(prepare), schema)


def tenth_repeated(doc_id: object, words: list[str]) -> list[str]:
    """One document in ten (by the checksum of its id, rows without an id excepted) with its words from a place on made periodic."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them made periodic: number of runs, the longest, digests of all runs and of the collapsed text."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), prepare=tenth_repeated)
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    # greatest length, then smallest start and period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("_l"), F.array_join(lines, "").alias("_runs"), "collapsed")
    length, period = F.col("_l.length"), -F.col("_l.period")
    return found.select(
        "doc_id", "n_runs", (-F.col("_l.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.call_function("div", length * 1000, period).alias("exponent_milli"), F.sha2("_runs", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
