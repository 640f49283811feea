"""The automaton against a search for one word after another."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.automaton import Words
from marlstone.plans import screening


def test_random_lists(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abÉ ") for _ in range(rng.randrange(1, 5)))
    lists = {n: [word() for _ in range(rng.randrange(1, 9))] for n in "xyz"} | {"none": [], "case": ["AB", "ab"]}
    texts = [None, ""] + ["".join(rng.choice("abé c") for _ in range(rng.randrange(60))) for _ in range(80)]
    words = Words(lists)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("f", words.found(F.col("t")))
    for row in df.select("t", *[words.hits(F.col("f"), n).alias(n) for n in lists]).collect():
        for n, those in lists.items():
            assert row[n] == [w for w in those if w.lower() in (row.t or "")]
    with pytest.raises(ValueError):
        Words({"x": [""]})


def test_signals_have_the_hits_of_plain_search(spark):
    texts = [" ".join(words[k % len(words)] for words in screening.KEYWORD_SIGNALS.values()) + " sentence." for k in range(12)] + ["", None, "Nothing here."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    names = list(screening.KEYWORD_SIGNALS)
    plain = df.select("k", *[F.coalesce(T.keyword_hits(T.fold(F.coalesce("text", F.lit(""))), screening.KEYWORD_SIGNALS[n])).alias(n) for n in names])
    want = {r.k: [r[n] for n in names] for r in plain.collect()}
    got = {r.k: [r[f"matched_{n}"] for n in names] for r in screening.signals(df).collect()}
    assert got == want and any(all(v) for v in want.values())
