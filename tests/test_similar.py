"""Similarity joins against plain loops over all pairs of a block."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import match, similar


def plain_tokens(s):
    out = []
    for t in "".join(c if c.isascii() and c.isalnum() else " " for c in (s or "").lower()).split():
        if t not in out:
            out.append(t)
    return out


def plain_key(s):
    return "".join(c for c in (s or "").lower() if c.isascii() and c.isalnum())


def plain_score(a, b, tokens):
    ka, kb = plain_key(a), plain_key(b)
    if not ka or not kb:
        return 0.0
    if ka == kb:
        return 1.0
    if ka in kb or kb in ka:
        return max(0.65, min(len(ka), len(kb)) / max(len(ka), len(kb)))
    ta, tb = set(plain_tokens(a)), set(plain_tokens(b))
    return len(ta & tb) / len(ta | tb) if tokens and ta | tb else 0.0


def random_names(rng, count):
    words = ["bc", "b", "hno3", "mg", "straw", "x1", "oak", "co", "coal", "a"]
    return [rng.choice([" ", "-", ""]).join(rng.choices(words, [9, 1, 1, 3, 5, 2, 1, 1, 1, 1], k=rng.randrange(1, 6))) for _ in range(count)]


@pytest.mark.parametrize("tokens", [False, True])
def test_fuzzy_top1(spark, monkeypatch, tokens):
    monkeypatch.setattr(similar, "TOGETHER", 3)
    rng = random.Random(4)
    asked = [(k, k % 3, n) for k, n in enumerate(random_names(rng, 90))] + [(900, 0, None), (901, 0, " - "), (902, 1, "")]
    known = [(k % 3, n) for k, n in enumerate(random_names(rng, 80))] + [(0, None), (1, "--"), (2, "straw straw"), (2, "straw straw")]
    got = {r.i: (r.n, round(r.score, 9)) for r in similar.fuzzy_top1(spark.createDataFrame(asked, "i int, b int, a string"), spark.createDataFrame(known, "b int, n string"), ["b"], "i", "a", "n", tokens=tokens).collect()}
    want = {}
    for i, b, a in asked:
        scored = [(-plain_score(a, n, tokens), n) for block, n in known if block == b and plain_score(a, n, tokens) >= 0.3]
        if scored:
            want[i] = (min(scored)[1], round(-min(scored)[0], 9))
    assert got == want and len(want) > 50


def test_token_overlap_splits_hot_tokens(spark, monkeypatch):
    monkeypatch.setattr(similar, "TOGETHER", 2)
    rng = random.Random(9)
    asked = list(enumerate(random_names(rng, 80))) + [(900, None)]
    known = random_names(rng, 70) + ["one", None]
    got = {r.i: (r.n, r.shared) for r in similar.token_overlap(spark.createDataFrame(asked, "i int, a string"), spark.createDataFrame([(n,) for n in known], "n string"), "i", "a", "n").collect()}
    want = {}
    for i, a in asked:
        scored = [(-len(set(plain_tokens(a)) & set(plain_tokens(n))), n) for n in known if len(set(plain_tokens(a)) & set(plain_tokens(n))) >= 2]
        if scored:
            want[i] = (min(scored)[1], -min(scored)[0])
    assert got == want and want


def test_alias_rules(spark):
    known = spark.createDataFrame([("p", "BC-Mg", 3), ("p", "Mg/BC composite", 1), ("p", "bc mg", 2), ("p", "Oak char 500", 4), ("q", "BC", 1)], "paper string, n string, ord int")
    asked = spark.createDataFrame([("p", 1, "bc-MG"), ("p", 2, "BC modified with Mg"), ("p", 3, "char of oak"), ("p", 4, "bc"), ("q", 5, "BC modified with Mg"), ("p", 6, None), ("p", 7, " mg MODIFIED  with bc ")], "paper string, i int, a string")
    got = {r.i: (r.n, r.rule) for r in similar.alias(asked, known, ["paper"], "i", "a", "n", "ord").collect()}
    assert got == {1: ("BC-Mg", "key"), 2: ("Mg/BC composite", "modified"), 3: ("Oak char 500", "tokens"), 7: ("Mg/BC composite", "modified")}


def test_class_from_the_rest_of_the_file(spark):
    known = spark.createDataFrame([("f", "hmb", "other"), ("f", "oak", "acid"), ("g", "oak", "acid"), ("g", "pine", "pristine"), ("h", "mb", "unknown")], "file string, _k string, cls string")
    asked = spark.createDataFrame([("f", 1, "OAK"), ("f", 2, "oak-500"), ("f", 3, "MB"), ("f", 4, ""), ("g", 5, None), ("h", 6, "mb"), ("f", 7, "ash"), ("z", 8, "")], "file string, i int, s string")
    got = {r.i: (r.cls, r.rule) for r in similar.inferred_class(asked, known, ["file"], "i", "s", "cls", ("acid", "pristine"), "pristine").collect()}
    assert got == {1: ("acid", "key"), 2: ("acid", "similar"), 3: ("pristine", "suffix"), 4: ("acid", "block")}


def test_family_chains(spark):
    known = spark.createDataFrame([("f", "sc", "acid"), ("f", "nsc", "other"), ("f", "nnsc", "unknown"), ("f", "nnnnsc", "unknown"), ("f", "ndc", "other"), ("g", "nsc", "other"), ("f", "n", "acid"), ("f", "nn", "other"), ("f", "", "acid")], "file string, _k string, cls string")
    assert {(r.file, r["_k"]) for r in similar.family_class(known, ["file"], "cls", ("acid", "pristine")).collect()} == {("f", "nsc"), ("f", "nnsc"), ("f", "nn")}


def test_best_unique_with_nulls(spark):
    rng = random.Random(2)
    make = lambda n, base: [(base + k, k % 2, *(rng.choice([None, 1, 2]) for _ in range(4))) for k in range(n)]
    rows, cands = make(40, 0), make(30, 100)
    fields = ["w", "x", "y", "z"]
    schema = "{} int, b int, w int, x int, y int, z int"
    got = {r.i: (r.c, r.score) for r in match.best_unique(spark.createDataFrame(rows, schema.format("i")), spark.createDataFrame(cands, schema.format("c")), ["b"], fields, "i", "c").collect()}
    want = {}
    for i, b, *own in rows:
        scored = sorted(((sum(p is not None and p == q for p, q in zip(own, other, strict=True)), c) for c, block, *other in cands if block == b), reverse=True)
        if scored and scored[0][0] >= 2 and (len(scored) == 1 or scored[1][0] < scored[0][0]):
            want[i] = scored[0][::-1]
    assert got == want and want


def test_no_pairs_of_a_block_are_formed(spark):
    """Names that share nothing rare meet nowhere: the join over grams has about as many rows as names."""
    names = spark.range(400).select(F.lit(1).alias("b"), F.concat(F.lit("sample"), F.sha2(F.col("id").cast("string"), 256)).alias("n"))
    longer = names.select("b", F.concat("n", F.lit("x")).alias("h"))
    assert similar.contained(names, longer, ["b"], "n", "h").count() == 400
