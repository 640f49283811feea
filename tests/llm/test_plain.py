"""Operators without SQL, and each stage of the pipeline, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from marlstone.llm import bpe, mjpeg, quality, shingles
from tests.conftest import DATA
from tests.llm.helpers import LONG, word_list
from tests.llm.test_documents import _brute

TEXTS = ["", " \n\t", "One two two Three.\nFOUR five, six! | 7#", "naïve ÀÉ 12 | x=1\x07\x7f", "a" * 300 + " b", "x y\n\nx y. x y?", LONG[:3000], "end with blank ", "ΣΣ ΣΣ"]


# ------------------------------------------------------------------ quality
def plain_statistics(text):
    raw = text.encode()
    if not raw:
        return [0.0] * 22
    kinds = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".", b",;:'\"()-", b"!?", b"|", b"#$%&*@^~_=+<>/\\[]{}`"]

    def kind(c):
        if c >= 128:
            return 0
        return next((k for k, chars in enumerate(kinds, 1) if c in chars), 11)

    counts = Counter(map(kind, raw))
    words = raw.split()
    folded = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    n, sizes = max(len(words), 1), [len(w) for w in words]
    mean = sum(sizes) / n
    return [
        math.log1p(len(words)), mean, math.sqrt(max(0.0, sum(s * s for s in sizes) / n - mean**2)), len(set(folded)) / n, sum(a == b for a, b in zip(folded, folded[1:], strict=False)) / n,
        *[counts[k] / len(raw) for k in range(12)], sum(len(w) > 1 and kind(w[0]) == kind(w[1]) == 2 for w in words) / n, sum(kind(w[-1]) >= 8 for w in words) / n,
        len(words) / (counts[5] + 1), len(words) / (counts[6] + 1), math.log1p(max(sizes, default=0)),
    ]


def test_statistics_against_plain_ones():
    want = np.array([plain_statistics(t) for t in TEXTS])
    raw = shingles.raw_bytes(pa.array(TEXTS))
    assert np.allclose(quality.statistics(*raw), want)
    for k, t in enumerate(TEXTS):  # a text taken by parts
        alone = shingles.raw_bytes(pa.array([t]))
        assert np.allclose(quality.statistics(*alone, part=16), want[k])


def test_long_texts_by_parts_have_the_same_shingles():
    for t in TEXTS:
        raw = shingles.raw_bytes(pa.array([t]))
        for part in (1, 7, 64):
            assert shingles.shingle_sets(*raw, part=part)[0].tolist() == shingles.shingle_sets(*raw)[0].tolist()


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (200, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=200) > 2.5).astype(float)
    forest = quality.fit(x, y, trees=1, depth=1)
    share = (y.sum() + 0.5) / 201
    grad, hess = share - y, np.full(200, share * (1 - share))
    best = (-1.0, None)
    for f in range(3):
        for cut in range(6):
            left = x[:, f] <= cut
            if quality.LEAST <= left.sum() <= 200 - quality.LEAST:
                parts = [(grad[s].sum() ** 2 / (hess[s].sum() + quality.RIDGE), s) for s in (left, ~left)]
                best = max(best, (parts[0][0] + parts[1][0], (f, cut)), key=lambda b: b[0])
    f, cut = best[1]
    root = forest.roots[0]
    assert forest.feature[root] == f and ((x[:, f] <= forest.threshold[root]) == (x[:, f] <= cut)).all()
    for node, side in ((forest.low[root], x[:, f] <= cut), (forest.high[root], x[:, f] > cut)):
        assert forest.value[node] == pytest.approx(-quality.RATE * grad[side].sum() / (hess[side].sum() + quality.RIDGE))


# ------------------------------------------------------------------ media
def plain_frame(jpeg):
    """One frame decoded bit by bit, tables read from its own segments."""
    at, codes, shape, predictor = 2, {}, None, None
    while True:
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            code, k = 0, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    codes[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xC3:
            shape = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        elif marker == 0xDA:
            predictor = body[-3]
            break
    assert predictor == 1 and jpeg[-2:] == b"\xff\xd9"
    bits = "".join(f"{b:08b}" for b in jpeg[at:-2].replace(b"\xff\x00", b"\xff"))
    out, pos = np.zeros(shape, int), 0
    for r in range(shape[0]):
        for c in range(shape[1]):
            length = 1
            while (length, int(bits[pos : pos + length], 2)) not in codes:
                length += 1
            s = codes[length, int(bits[pos : pos + length], 2)]
            pos += length
            extra = int(bits[pos : pos + s], 2) if s else 0
            pos += s
            difference = extra if not s or extra >> (s - 1) else extra - (1 << s) + 1
            before = out[r, c - 1] if c else out[r - 1, 0] if r else 128
            out[r, c] = before + difference
    return out.ravel()


def plain_shots(frames):
    hist = [Counter(int(v) >> 4 for v in f) for f in frames]
    change = [sum(abs(a[k] - b[k]) for k in range(16)) for a, b in zip(hist, hist[1:], strict=False)]
    out = [0]
    for i, c in enumerate(change):
        near = [change[j] for j in range(max(0, i - mjpeg.AROUND), min(len(change), i + mjpeg.AROUND + 1)) if j != i]
        if len(change) < 2:
            break
        mean = sum(near) / len(near)
        spread = math.sqrt(max(0.0, sum(v * v for v in near) / len(near) - mean**2))
        if c > mean + mjpeg.DEVIATIONS * spread and c >= max(near) and c > mjpeg.FRAME / 10:
            out.append(i + 1)
    return out


def test_media_query_against_plain_decoding(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas()
    got = {r.doc_id: r for r in mjpeg.op3_avi_mjpeg_shots(spark, DATA).toPandas().itertuples()}
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(docs.itertuples(index=False, name=None)):
        raw = (text or "").encode()
        raw += b" " * ((-len(raw)) % mjpeg.FRAME if raw else mjpeg.FRAME)
        frames = np.frombuffer(raw, np.uint8).reshape(-1, mjpeg.FRAME)
        avi = mjpeg.write_avis(frames, np.array([len(frames)]))[0]
        assert (got[i].media_bytes, got[i].media_sha256, got[i].payload_sha256) == (len(avi), hashlib.sha256(avi).hexdigest(), hashlib.sha256(raw).hexdigest())
        assert got[i].feature == f"frames={len(frames)};shots={','.join(map(str, plain_shots(frames)))}"
        if k < 8:
            at, stops = mjpeg.frame_places(avi)
            assert all((plain_frame(avi[a:b]) == f).all() for a, b, f in zip(at, stops, frames, strict=True))


def test_index_with_places_from_the_file_start():
    frames = np.arange(2 * mjpeg.FRAME, dtype=np.int64).reshape(2, -1).astype(np.uint8)
    avi = bytearray(mjpeg.write_avis(frames, np.array([2]))[0])
    starts, stops = mjpeg.frame_places(bytes(avi))
    index = avi.rindex(b"idx1") + 8
    for k, start in enumerate(starts.tolist()):
        avi[index + 16 * k + 8 : index + 16 * k + 12] = (start - 8).to_bytes(4, "little")
    again = mjpeg.frame_places(bytes(avi))
    assert again[0].tolist() == starts.tolist() and again[1].tolist() == stops.tolist()


def masked(line):
    """Tokens of a line, those with a digit as None."""
    return tuple(None if re.search("[0-9]", t) else t for t in re.split(r"[ \t\x0B\f\r]+", line.strip(" \t\x0b\f\r")) if t)


def plain_line_dedup(rows):
    """rows (id, text) with unique ids -> text by id."""
    leaves = defaultdict(lambda: defaultdict(set))
    for i, text in rows:
        for line in (text or "").split("\n"):
            tokens = masked(line)
            if 2 * sum(t is not None for t in tokens) > len(tokens):
                leaves[len(tokens), tokens[:3]][tokens].add(i)

    def key(line):
        tokens = masked(line)
        n = len(tokens)
        if 2 * sum(t is not None for t in tokens) <= n:
            return line
        met = leaves[n, tokens[:3]]
        often = [sum(len(docs) for other, docs in met.items() if other[k] == t) for k, t in enumerate(tokens)]
        support = sorted((c for c, t in zip(often, tokens, strict=True) if t is not None), reverse=True)[n // 2]
        return n, tokens[:3], tuple(t if t is not None and 2 * c >= support else None for c, t in zip(often, tokens, strict=True))

    keys = {line: key(line) for _, text in rows for line in (text or "").split("\n") if masked(line)}
    having = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if line in keys:
                having[keys[line]].add(i)
    out = {}
    for i, text in rows:
        if text is None:
            out[i] = None
            continue
        lines = text.split("\n")
        kept = [x for x in lines if x not in keys or min(having[keys[x]]) >= i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages_against_plain_versions(spark):
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    # classifier: the forest of the stage, walked over plain statistics
    forest = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = {}
    for i, t in texts.items():
        row, logit = plain_statistics(t or ""), forest.base
        for root in forest.roots:
            node = root
            while forest.low[node] != node:
                node = forest.low[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.high[node]
            logit += forest.value[node]
        scores[i] = 1 / (1 + math.exp(-logit))
    docs = stages["quality_classifier"](spark, docs, DATA).cache()
    good = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(good) == {i for i, s in scores.items() if s >= 0.5} and all(good[i] == texts[i] for i in good)
    # lines
    plain = plain_line_dedup(list(good.items()))
    docs = stages["line_dedup"](spark, docs, DATA).cache()
    lines = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert lines == {i: v[0] for i, v in plain.items() if v[2] == 0 or v[2] < v[1]}
    # near-duplicates: the least id of each component, and documents without words
    docs = stages["minhash_near_dedup"](spark, docs, DATA).cache()
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept) == {i for i, (n, root) in _brute(list(lines.items()), 80).items() if i == root or n == 0} and all(kept[i] == lines[i] for i in kept)
    # mixing: sources at their targets, no text more than twice, one cut
    mixed = stages["source_mixing"](spark, docs, DATA).cache()
    rows = mixed.collect()
    sizes = {i: len(word_list(t)) for i, t in kept.items()}
    taken = Counter()
    for r in rows:
        taken[r["doc_id"]] += len(word_list(r["text"]))
    assert sum(taken.values()) == int(1.5 * sum(sizes.values())) and all(taken[i] <= 2 * sizes[i] for i in sizes)
    assert sum(r["text"] != kept[r["doc_id"]] for r in rows) <= 1 and all((kept[r["doc_id"]] or "").startswith(r["text"] or "") for r in rows)
    # tokens
    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in stages["bpe_encoding"](spark, mixed, DATA).collect())
    assert got == Counter((r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows)


def test_line_dedup_against_a_plain_version(spark):
    from marlstone.llm import line_dedup

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["text"], r["lines"], r["dropped_lines"]) for r in line_dedup.op10_line_template_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: v if v else (None, 0, 0) for i, v in plain_line_dedup(rows).items()}


def test_heavy_keys_meet_their_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from marlstone.llm import heavy

    monkeypatch.setattr(heavy, "HEAVY", 10)
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 50).cast("long").alias("k"), "id")
    keyed = rows.where("k < 40").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    want = sorted((r["k"], r["id"], r["m"]) for r in rows.join(keyed, "k").collect())
    assert sorted((r["k"], r["id"], r["m"]) for r in heavy.join_by_key(rows, keyed, ["k"], "n", 1000).collect()) == want
    left = heavy.join_by_key(rows, keyed, ["k"], "n", 1000, "left")
    assert left.count() == 1000 and sorted((r["k"], r["id"], r["m"]) for r in left.where("m is not null").collect()) == want


def test_payload_checksums_are_of_the_last_sixteen_bytes(spark):
    row = mjpeg.read_media(mjpeg.write_media(spark.createDataFrame([(1, "é" * 500)], "doc_id long, text string"))).first()
    payload = ("é" * 500).encode() + b" " * (-1000 % 192)
    assert row["tail_crc32"] == zlib.crc32(payload[-16:]) and row["payload_bytes"] == len(payload)
