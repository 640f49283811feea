"""Periodic runs against a search that tries every period at every place."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from marlstone.llm.periodic import collapsed, op13_periodic_runs, periodic_runs, periodic_runs_of
from tests.conftest import DATA
from tests.llm.helpers import LONG, awkward, empty


def plain_runs(words):
    """Every longest stretch of each period, kept if no smaller period holds in all of it."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if j > i and len(stretch) >= max(12, 2 * q) and not any(all(x == y for x, y in zip(stretch, stretch[p:], strict=False)) for p in range(1, q)):
                out.append((i, len(stretch), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_kept(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_random_words():
    rng = random.Random(5)
    for _ in range(400):
        letters = rng.choice([1, 2, 3, 5, 40])
        words = [str(rng.randrange(letters)) for _ in range(rng.randrange(1, 90))]
        for _ in range(rng.randrange(3)):
            at, length, times = rng.randrange(len(words)), rng.randrange(1, 30), rng.randrange(2, 6)
            words[at:at] = (words[at : at + length] * times)[: rng.randrange(1, 120)]
        runs = periodic_runs_of(words)
        assert runs == plain_runs(words)
        assert collapsed(words, runs) == plain_kept(words, runs)


@pytest.mark.parametrize("unit", [["a"], ["a"] * 50 + ["b"], ["a"] * 40 + ["b"] * 40, [str(k) for k in range(70)], (["x", "y"] * 20 + ["z"]) * 3 + ["w"]])
def test_repeated_units(unit):
    rng = random.Random(len(unit))
    for times in (2, 3, 7):
        words = [str(rng.random()) for _ in range(9)] + unit * times + unit[: len(unit) // 3] + [str(rng.random()) for _ in range(5)]
        assert periodic_runs_of(words) == plain_runs(words)


def test_nested_fibonacci_words():
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    assert periodic_runs_of(b) == plain_runs(b)


def test_very_long_text_of_one_period(spark):
    words = LONG.split()
    assert periodic_runs_of(words) == [(0, len(words), 6)]
    assert periodic_runs_of(["w"] * 300_000) == [(0, 300_000, 1)]


def test_awkward_rows(spark):
    rows = periodic_runs(awkward(spark)).collect()
    assert len(rows) == 12
    long = next(r for r in rows if r.doc_id == 5)
    assert [tuple(x) for x in long.runs] == [(0, len(LONG.split()), 6)] and long.collapsed == " ".join(LONG.split()[:6])
    assert all((r.n_words, r.runs, r.collapsed) == (0, [], "") for r in rows if r.doc_id in (2, 3, 4))
    assert periodic_runs(empty(spark)).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(F.length("text") < 9000)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in op13_periodic_runs(spark, DATA).collect()}
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    planted = 0
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        row = got[doc_id]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(plain_kept(words, runs).encode()).hexdigest()
    assert planted > 5 and any(r.n_runs for r in got.values())
