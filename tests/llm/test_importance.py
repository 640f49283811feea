"""Importance resampling against a plain version, over whole texts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from marlstone.llm import importance
from marlstone.llm.shingles import raw_bytes
from tests.llm.helpers import LONG, awkward, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def plain_buckets(text, buckets, most=2):
    words = WORD.findall(lower(text))
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(words) - n + 1))


def plain(rows, target, buckets=10_000, percent=25, least=20, seed=7):
    """Rows ``(id, text)`` to ``(id, n_features, n_words, weight, score, rank)``."""
    s, t = Counter(), Counter()
    for _, text in rows:
        s += plain_buckets(text, buckets)[1]
    for text in target:
        t += plain_buckets(text, buckets)[1]
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        n_words, own = plain_buckets(text, buckets)
        n = sum(own.values())
        gain = sum(c * math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b, c in own.items())
        weight = gain // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, n_words, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[2] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[1], r[3]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.n_words, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_buckets_of_odd_texts():
    texts = ["Ab c9 ab", None, "", "__ !", "é€😀x y", "x" * 200 + " " + "y" * 99 + "\x00z", "end", "start again " * 50, "a"]
    bucket, owner, words = importance.ngram_buckets(*raw_bytes(pa.array(texts)), 997, 3)
    for k, text in enumerate(texts):
        n, want = plain_buckets(text, 997, 3)
        assert words[k] == n and Counter(bucket[owner == k].tolist()) == want


def test_awkward_rows(spark):
    docs = awkward(spark)
    target = spark.createDataFrame([("the lazy dog near the river",), (None,), ("",)], "text string")
    source = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = rows_of(importance.resample(docs, target))
    assert got == plain(source, ["the lazy dog near the river", None, ""]) and len(got) == 12


def test_copies_and_a_bucket_that_all_share(spark, monkeypatch):
    monkeypatch.setattr(importance, "SLICE", 3000)
    rows = [(k, f"common words here {k % 7} " * (5 + k % 3)) for k in range(300)] + [(500, "same row " * 15)] * 40 + [(None, LONG[:2000])] * 3 + [(600, "")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    target = spark.createDataFrame([("common words",), ("same row 3 here",)], "text string")
    assert rows_of(importance.resample(docs, target, percent=40)) == plain(rows, ["common words", "same row 3 here"], percent=40)
    few = importance.resample(docs, target, buckets=5)
    assert [r[:4] for r in rows_of(few)] == [r[:4] for r in plain(rows, ["common words", "same row 3 here"], buckets=5)]


def test_empty_tables_and_string_ids(spark):
    target = spark.createDataFrame([("the dog",)], "text string")
    assert importance.resample(empty(spark), target).count() == 0
    docs = spark.createDataFrame([("a", "the dog " * 12), ("b", None)], "doc_id string, text string")
    got = {r.doc_id: r for r in importance.resample(docs, target.where("false"), percent=100).collect()}
    assert got["a"].n_features == 47 and got["a"]["rank"] == 1 and (got["b"].weight, got["b"]["rank"]) == (0, None)


def test_gains_round_down():
    assert importance.gains(np.array([0, 9]), 9, np.array([0, 0]), 0, 10).tolist() == [math.floor(1000 * math.log(19 / 10)), math.floor(1000 * math.log(19 / 100))]
