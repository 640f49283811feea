"""Operators over vectors, pages and conversations, and the pipeline."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from marlstone.llm import chat, components, topk, warc
from tests.conftest import DATA
from tests.llm.helpers import awkward, empty


# ------------------------------------------------------------------ top-k
def _brute(rows, k, every):
    ints = [(i, np.floor(64 * np.asarray(v, np.float64)).astype(np.int64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in sorted(ints, key=lambda r: tuple(r[1]), reverse=True)}.items():
        if q % every:
            continue
        scores = sorted((-int(a[: len(b)] @ b[: len(a)]), i) for i, b in ints if i != q)[:k]
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)}
    return out


def test_topk_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 0.5, 1, 3])).astype(float).tolist()) for i in range(700)]
    rows += [(700 + i, [0.5] * 8) for i in range(300)]  # one very common vector
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (2080, [0.0] * 8), (2100, [])]
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, floor int, norm2 double")
    got = topk.top_k(df, k=5)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()} == _brute(rows, 5, 20)


def test_topk_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (None, [3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(df.where("false")).count() == 0


def test_topk_prunes_by_both_rules_exactly():
    import pandas as pd

    rng = np.random.default_rng(9)
    block = pd.DataFrame({"vec_id": np.arange(400), "ints": list(rng.integers(-50, 50, (400, 6)))})
    block["norm2"] = [float(v @ v) for v in block["ints"]]
    queries = block.iloc[:40].assign(vec_id=lambda d: d.vec_id + 1000)
    for share in (-1.0, 0.2, 0.9, 2.0):  # floors that prune nothing, by length, by coordinates, all
        floors = share * np.sqrt(queries["norm2"]) * np.sqrt(block["norm2"].max())
        got = topk.best_in_block(queries.assign(floor=floors), block, 7)
        want = set()
        for q, f in zip(queries.itertuples(), floors, strict=True):
            scores = sorted((-int(np.dot(q.ints, v)), i) for i, v in zip(block.vec_id, block.ints, strict=True) if np.dot(q.ints, v) >= f)
            want |= {(q.vec_id, i, -s) for s, i in scores[:7]}
        assert set(got.itertuples(index=False, name=None)) == want


def test_topk_beyond_64_bits():
    big = np.array([[1 << 40, 3]], np.int64)
    assert topk._products(big, np.array([[1 << 21, 5], [-(1 << 21), 1]], np.int64)).tolist() == [[(1 << 61) + 15, -(1 << 61) + 3]]
    assert topk._products(np.array([[1 << 61, 1 << 61]], np.int64), np.array([[2, -1]], np.int64)).tolist() == [[1 << 61]]
    with pytest.raises(OverflowError):
        topk._products(np.array([[3_000_000_000 * 64] * 2], np.int64), np.array([[3_000_000_000 * 64] * 2], np.int64))


# ------------------------------------------------------------------ WARC
def _pages(spark):
    rows = [(3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, None, None), (4, "http://b", ""), (None, "http://n", "same"), (5, "http://c/ü", "ü\r\n\r\nx"), (1, "http://a/1", "same"), (6, "http://d", "y" * 300_000)]
    return spark.createDataFrame([(*r, "zzz", 0) for r in rows], "page_id long, url string, html string, digest string, offset long")


def test_archives_round_trip(spark):
    index = warc.write_archives(_pages(spark))
    rows = warc.read_records(index).collect()
    assert len(rows) == 8
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows)
    assert got == Counter([(1, 4, "response", None)] * 2 + [(3, 4, "revisit", 1), (None, 4, "revisit", 1), (2, 0, "response", None), (4, 0, "revisit", 2), (5, 7, "response", None), (6, 300_000, "response", None)])
    assert {r["page_id"]: bytes(r["payload"]) for r in rows if r["page_id"] == 5} == {5: "ü\r\n\r\nx".encode()}
    assert all(r["payload_digest"] == warc.payload_digest(r["payload"]) for r in rows if r["record_type"] == "response")
    some = warc.read_records(index.where("page_id in (5, 6)"))
    assert {r["page_id"] for r in some.collect()} == {5, 6}
    assert warc.read_records(warc.write_archives(_pages(spark).where("false"))).count() == 0


def test_many_archives_are_read_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 20_000)
    rng = np.random.default_rng(1)
    rows = [(i, f"http://x/{i}", rng.bytes(1500).hex() if i % 3 else "hot page " * 20) for i in range(300)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), file_bytes=50_000)
    assert index.select("file").distinct().count() > 6
    read = warc.read_records(index)
    assert read.rdd.getNumPartitions() > 10
    got = {r["page_id"]: (r["record_type"], r["refers_to"], bytes(r["payload"] or b"").decode()) for r in read.collect()}
    assert got == {i: ("response", None, h) if i % 3 or i == 0 else ("revisit", 0, "") for i, _, h in rows}


def test_ranges_are_coalesced():
    offsets, lengths = np.array([0, 10, 30, 1000, 1010]), np.array([10, 10, 5, 10, 10])
    assert warc.coalesce_ranges(offsets, lengths, gap=20, most=100) == [(0, 3), (3, 5)]
    assert warc.coalesce_ranges(offsets, lengths, gap=20, most=20) == [(0, 2), (2, 3), (3, 5)]
    assert warc.coalesce_ranges(offsets[:0], lengths[:0]) == []


def test_damage_is_noticed():
    data, _ = warc.record(1, "http://a", b"payload", None)
    assert warc.parse_record(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(data.replace(b"payload\r\n", b"pay1oad\r\n"))


# ------------------------------------------------------------------ chat
def test_every_participant_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|> there"), (1, 2, "bo b", "Hello"), (1, 3, "ann", None), (1, None, None, "late"), (2, 0, "system", "alone"), (None, 0, "cy", "é"), (None, 0, "cy", "é")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, speaker string")
    found = chat.rotate_perspectives(df).collect()
    out = {(r["conv_id"], r["speaker"]): r for r in found}
    assert set(out) == {(1, "ann"), (1, "bo b"), (None, "cy")} and len(found) == 4
    ann = out[1, "ann"]
    assert ann["text"] == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi <|im_end > there<|im_end|>\n"
        "<|im_start|>user name=bo_b\nHello<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=unknown\nlate<|im_end|>\n"
    )
    spans = [tuple(map(int, s.split(":"))) for s in ann["mask"].split(",")]
    assert [ann["text"][a:b] for a, b in spans] == ["Hi <|im_end > there<|im_end|>", "<|im_end|>"] and ann["turns"] == 5
    assert out[None, "cy"]["turns"] == 1 and out[None, "cy"]["text"][slice(*map(int, out[None, "cy"]["mask"].split(":")))] == "é<|im_end|>"
    assert chat.rotate_perspectives(df.where("false")).count() == 0


def test_a_long_dialogue_is_one_row(spark):
    rows = [(7, t, ("ann", "bo", "system")[t % 3], f"says {t} " + "ü" * (t % 5)) for t in range(3000)] + [(7, 5, "bo", "tie")] * 2 + [(8, 1, "cy", "long " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["speaker"]: r for r in chat.rotate_perspectives(df.repartition(5)).collect()}
    assert set(out) == {"ann", "bo", "cy"} and out["ann"]["turns"] == out["bo"]["turns"] == 3002
    for who in ("ann", "bo"):
        spans = [tuple(map(int, s.split(":"))) for s in out[who]["mask"].split(",")]
        said = sorted((t, r, x) for _, t, r, x in rows if r == who)
        assert [out[who]["text"][a:b] for a, b in spans] == [x + "<|im_end|>" for _, _, x in said]
    assert len(out["cy"]["text"]) > 1_000_000


# ------------------------------------------------------------------ components
def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# ------------------------------------------------------------------ pipeline
def test_pipeline_stage_by_stage(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "source_mixing", "bpe_encoding"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == names, name
        assert docs.where("n_chars <> length(text)").count() == 0
        sizes.append(docs.count())
    assert 0 < sizes[2] <= sizes[1] <= sizes[0] < 200
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert tokens.count() == sizes[3]
    assert Counter(r[0] for r in corpus_pipeline.run(spark, DATA).select("n_tokens").collect()) == Counter(r[0] for r in tokens.select("n_tokens").collect())


def test_pipeline_on_awkward_and_empty_rows(spark):
    for rows in (awkward(spark), empty(spark)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
        docs.collect()
