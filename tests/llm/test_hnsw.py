"""Graph search against brute force: recall, exact scores, order, copies and awkward vectors."""

import math

import numpy as np

from marlstone.llm import hnsw
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<double>, label int, _shard int, _row long, vector string, score int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x", 4) for i, v in vectors], SCHEMA)


def brute(vectors, k, every):
    """Nearest rows of each query: (query, rank, id, cosine)."""
    width = max(len(v) for _, v in vectors)
    rows = [(i, [*v, *[0.0] * (width - len(v))]) for i, v in vectors]
    asked = {}
    for i, v in rows:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = {}
    for q, a in asked.items():
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in v)), i) for i, v in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_and_scores_of_the_query(spark):
    source = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = brute(source, 5, 50)
    got = hnsw.op12_shard_graphs(spark, DATA).collect()
    vectors = dict(source)
    found = 0
    for q, expected in want.items():
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in rows] == [1, 2, 3, 4, 5] and all(r.vec_id != q for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        for r in rows:
            a, b = np.array(vectors[q]), np.array(vectors[r.vec_id])
            assert math.isclose(r.score, float(a @ b) / math.sqrt(float(a @ a) * float(b @ b)), rel_tol=1e-12, abs_tol=1e-15)
        found += len({r.vec_id for r in rows} & {i for i, _ in expected})
    assert len(got) == 5 * len(want) and found >= 0.9 * 5 * len(want)


def test_recall_of_a_large_shard_with_clusters():
    rng = np.random.default_rng(3)
    loose, centres = rng.normal(size=(6000, 32)), rng.normal(size=(40, 32))
    tight = np.repeat(centres, 50, axis=0) + 0.01 * rng.normal(size=(2000, 32))
    x = hnsw._units(rng.permutation(np.concatenate([loose, tight])))
    layers, apart = hnsw.grow_layers(x)
    assert len(layers) == 3 and all((links < len(links)).all() for links in layers)
    asked = x[::97]
    met, near = hnsw._beam(x, layers[-1], asked, hnsw._descend(x, layers[:-1], asked, len(x)), hnsw.ASKING)
    exact = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :5]
    assert (np.diff(near, axis=1) <= 0).all()
    assert np.mean([len(set(a) & set(b[:5].tolist()) | set(a) & set(apart.tolist())) / 5 for a, b in zip(exact.tolist(), met, strict=True)]) >= 0.95


def test_copies_ties_and_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(k, [1.0, 2.0, 3.0]) for k in range(1, 41)] + [(50, [1.0, 2.0, 3.0]), (50, [1.0, 0.0]), (100, [0.0, 0.0, 1e-200]), (150, [1e200, 0.0, 0.0]), (7, [1.0, 2.0, 3.0]), (41, [-1.0]), (42, [2.0, 4.0, 6.0])]
    odd = [(None, [1.0]), (200, None), (250, []), (300, [0.0, 0.0]), (350, [1.0, nan]), (400, [inf]), (450, [1.0, None])]
    got = {}
    for r in hnsw.nearest(table(spark, vectors + odd), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {50, 100, 150}
    # of id 50 the least vector asks: [1, 0]
    assert [i for _, i, _ in sorted(got[50])] == [150, 1, 2, 3, 4] and sorted(got[50])[0][2] == 1.0
    assert [i for _, i, _ in sorted(got[100])][:5] == [1, 2, 3, 4, 5]
    assert all(math.isclose(s, 3 / math.sqrt(14), rel_tol=1e-12) for _, _, s in got[100])
    # the query's own id is out, other rows of one id count each
    assert sorted(got[150])[0][1:] == (50, 1.0)


def test_fewer_candidates_and_empty_tables(spark):
    few = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])]
    rows = [(r.query_id, r["rank"], r.vec_id) for r in hnsw.nearest(table(spark, few)).orderBy("query_id", "rank").collect()]
    assert rows == [(0, 1, 3), (0, 2, 50), (50, 1, 3), (50, 2, 0)]
    assert hnsw.nearest(table(spark, [(50, [1.0])])).count() == 0
    assert hnsw.nearest(table(spark, [])).count() == 0
    assert hnsw.nearest(table(spark, [(1, [1.0]), (2, [2.0])])).count() == 0


def test_several_shards_hold_the_same_answer(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "LEAST_ROWS", 64)
    monkeypatch.setattr(hnsw, "QUERY_BYTES", 64 * 8 * 4)
    rng = np.random.default_rng(11)
    vectors = [(k, rng.normal(size=8).tolist()) for k in range(400)] + [(k, [1.0] * 8) for k in range(400, 500)]
    want = brute(vectors, 5, 50)
    got = {}
    for r in hnsw.nearest(table(spark, vectors)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
