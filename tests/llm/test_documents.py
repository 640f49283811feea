"""Operators over documents: awkward rows, empty tables, brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marlstone.llm import bpe, line_dedup, minhash, mixing, mjpeg, quality, registry, sharding
from tests.conftest import DATA
from tests.llm.helpers import LONG, awkward, empty, word_list


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 11)}


# ------------------------------------------------------------------ mixing
def test_mix_takes_the_budget_and_meets_targets(spark):
    out = mixing.op1_weighted_fair_mix(spark, DATA).toPandas()
    assert out.taken.sum() == int(out["size"].sum() * 1.5)
    assert ((out.taken >= 0) & (out.taken <= 2 * out["size"])).all()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source").toPandas()
    both = out.merge(docs, on="doc_id")
    largest = both["size"].max()
    for _, rows in both.groupby("source"):
        assert abs(rows.taken.sum() - rows.target.iloc[0]) <= largest
    assert mixing.op1_weighted_fair_mix(spark, DATA).toPandas().sort_values("doc_id").equals(out.sort_values("doc_id"))


def test_mix_awkward_rows(spark):
    out = mixing.schedule(awkward(spark)).collect()
    assert len(out) == 12
    sizes = Counter(r["_size"] for r in out)
    assert sizes[0] == 3 and sizes[120_000] == 1 and sizes[2] == 3
    assert sum(sum(r["_takes"]) for r in out) == int(sum(r["_size"] for r in out) * 1.5)
    assert mixing.schedule(empty(spark)).count() == 0


def test_mixed_corpus_keeps_columns_and_cuts_the_last_text(spark):
    docs = awkward(spark).where("doc_id <> 5 or doc_id is null")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    planned = sum(sum(r["_takes"]) for r in mixing.schedule(docs).collect())
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == planned
    assert mixing.mix(empty(spark)).count() == 0


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("0a", 10), ("0b", 1000), ("0c", 1000), ("1", 100)], "_src string, source_size long")
    out = {r["_src"]: r["target"] for r in mixing.source_targets(sizes, (5, 2, 1), 1.5, 2).collect()}
    total = 2110 * 1.5
    assert out["0a"] == 20 and out["1"] == 200  # both stop at twice their size
    assert out["0b"] == pytest.approx((total - 220) * 2 / 3) and out["0c"] == pytest.approx((total - 220) / 3)


# ------------------------------------------------------------------ line dedup
def test_lines_of_the_first_document_stay(spark):
    shared = "a passage of several words that recurs in many places number {} indeed"
    rows = [(i, shared.format(i * 37) + f"\nown line {'x' * (i + 1)} of document with words {'abcdefg'[i]} alone\nRe.") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["dropped_lines"] == 0
    for i in range(1, 5):
        assert out[i]["text"] == rows[i][1].split("\n")[1] and out[i]["dropped_lines"] == 2


def test_lines_of_any_length_follow_one_rule(spark):
    short = "All rights reserved.\nLicensed under CC BY-NC 4.0.\n\n \n1 2 3 4 5 6 7 8 9 ten"
    rows = [(i, f"{short}\nalone {'abcdefg'[i]}\nMenu\ncopyright notice {2000 + i}\n{i} of {i}") for i in range(7)]
    out = {r["doc_id"]: r for r in line_dedup.drop_recurring_lines(spark.createDataFrame([*rows, (9, "Licensed under CC BY-NC 3.0.\nMenu\n1 2 3 4")], "doc_id long, text string")).collect()}
    assert out[0]["text"] == rows[0][1]
    for i in range(1, 7):  # blank lines, tokens on the path to the leaf and lines that are mostly numbers stay
        assert out[i]["text"] == f"\n \nalone {'abcdefg'[i]}\n{i} of {i}" and out[i]["dropped_lines"] == 5
    assert out[9]["text"] == "1 2 3 4"


def test_any_number_of_fields_varies(spark):
    words = "the quick report of station about wind and rain at noon was sent from here".split()
    rows = []
    for i, fields in enumerate(zip(["red", "blue", "green", "grey", "pink"], ["oslo", "rome", "lima", "bern", "kyiv"], ["cat", "dog", "owl", "bee", "elk"], strict=True)):
        line = list(words)
        line[4], line[9], line[13] = fields
        rows.append((i, " ".join(line)))
    # two of the same form are too few to tell a field from another sentence
    rows += [(10, "we went to Paris"), (11, "we went to London"), (12, "they stayed in Bonn"), (13, "they stayed in Graz"), (14, "they stayed in Ulm")]
    # half of the tokens differ
    rows += [(20 + i, f"one two three {w} {w} {w} {w}") for i, w in enumerate(["a", "b", "c", "d"])]
    out = {r["doc_id"]: r["dropped_lines"] for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, n in sorted(out.items()) if n] == [1, 2, 3, 4, 13, 14]


def test_lines_awkward_rows(spark):
    docs = awkward(spark)
    out = line_dedup.drop_recurring_lines(docs)
    assert out.columns == [*docs.columns, "lines", "dropped_lines"]
    rows = defaultdict(list)
    for r in out.collect():
        rows[r["doc_id"]].append(r)
    assert rows[2][0]["text"] is None and rows[2][0]["lines"] == 0
    assert rows[3][0]["text"] == "" and rows[3][0]["lines"] == 1
    assert rows[1][0]["dropped_lines"] == 0 and rows[6][0]["text"] == ""  # an exact copy keeps nothing
    assert rows[5][0]["text"] == LONG and len(rows[9]) == 2 and len(rows[10]) == 2
    assert line_dedup.drop_recurring_lines(empty(spark)).count() == 0


# ------------------------------------------------------------------ near-duplicates
def _brute(rows, threshold):
    sets = {}
    for i, text in rows:
        w = word_list(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("threshold", [85, 80])
def test_near_duplicates_against_brute_force(spark, threshold):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = minhash.near_duplicates(docs, threshold).toPandas()
    want = _brute(docs.select("doc_id", "text").toPandas().itertuples(index=False, name=None), threshold)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.itertuples()} == want
    assert (out.kept == (out.doc_id == out.component_id)).all()


def test_near_duplicates_of_a_large_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(400):  # variants of one text, in chains and stars, over several blocks
        words = list(base)
        for _ in range(rng.integers(0, 5)):
            words[rng.integers(0, 120)] = f"x{rng.integers(0, 30)}"
        rows.append((i, " ".join(words)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.itertuples()} == _brute(rows, 85)


@pytest.mark.parametrize("changed", [3, 9])
def test_near_duplicates_of_two_thousand_variants(spark, monkeypatch, changed):
    """Distinct near copies of which most (3) or few (9) are linked with their hub; small blocks, so that many jobs meet."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    monkeypatch.setattr(minhash, "LEAVES", 50)
    rng = np.random.default_rng(changed)
    rows = []
    for i in range(2000):
        words = [f"w{k}" for k in range(150)]
        for at in rng.choice(150, rng.integers(0, changed), replace=False):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sets = {}
    for i, text in rows:
        w = text.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    columns = {s: k for k, s in enumerate(set().union(*sets.values()))}
    common = np.zeros((2000, 2000), np.float32)
    has = np.zeros((2000, len(columns)), np.float32)
    for i, s in sets.items():
        has[i, [columns[x] for x in s]] = 1
    common = has @ has.T
    size = has.sum(axis=1)
    linked = 100 * common >= 85 * (size[:, None] + size[None, :] - common)
    root = np.arange(2000)
    while True:  # least id reachable
        least = np.where(linked, root[None, :], 2000).min(axis=1)
        if (least == root).all():
            break
        root = least
    assert dict(zip(out.doc_id, out.component_id, strict=True)) == dict(enumerate(root.tolist()))


def test_one_of_each_group_stays(spark):
    copy = "the same words in every one of these many rows of text"
    rows = [(3, copy, "a"), (3, copy, "b"), (3, copy + " indeed", "c"), (2, copy.upper(), "d"), (None, copy, "e"), (None, "rows without any id but with words", "f"), (None, "rows without any id but with words", "g"), (7, "", "h"), (7, "", "i"), (None, None, "j"), (8, " \t", "k")]
    out = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, root string"), threshold=80)
    got = [r["root"] for r in out.collect()]
    assert out.columns == ["doc_id", "text", "root"] and {"d", "h", "i", "j", "k"} <= set(got) and len(got) == 6 and len({"f", "g"} & set(got)) == 1


def test_text_ids(spark):
    text = "a passage of ten words or so that recurs here twice over"
    docs = spark.createDataFrame([("b", text, "s"), ("a", text + "\nindeed", "s"), (None, text, None)], "doc_id string, text string, source string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 60).collect()} == {"a": "a", "b": "a", None: "a"}
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(docs).collect()} == {"a": text + "\nindeed", "b": "", None: ""}
    words = len(text.split())
    assert sum(sum(r["_takes"]) for r in mixing.schedule(docs).collect()) == int(1.5 * (3 * words + 1)) and mixing.mix(docs).columns == docs.columns
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, quality int")
    assert quality.score_documents(docs, quality.train(docs, labels)).count() == 3


def test_line_counts_have_free_names(spark):
    docs = spark.createDataFrame([(1, "x y\nz", 42, 7), (2, "x y", 43, 8)], "doc_id long, text string, lines int, lines_ int")
    out = {r["doc_id"]: r for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert (out[1]["lines"], out[1]["lines_"], out[1]["lines__"], out[1]["dropped_lines"]) == (42, 7, 2, 0) and (out[2]["lines"], out[2]["lines__"], out[2]["dropped_lines"]) == (43, 1, 1)


def test_near_duplicates_awkward_rows(spark):
    out = minhash.near_duplicates(awkward(spark)).collect()
    assert len(out) == 12
    found = defaultdict(list)
    for r in out:
        found[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert found[6] == [(10, 1, False)] and found[1] == [(10, 1, True)]
    assert found[2] == [(0, 2, True)] and found[3] == [(0, 3, True)] and found[4] == [(0, 4, True)]
    assert found[9] == [(1, 8, False)] * 2 and found[8] == [(1, 8, True)]
    assert found[None] == [(5, None, True)] and found[5][0][0] == 6
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_signature_agrees_with_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2))
    b = np.sort(np.concatenate([a[:1700], np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2))]))
    sig = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.15
    one = minhash.signatures(np.array([5], np.uint64), np.array([0, 1]))
    assert (one == 5).all()  # a single hash fills every bin


# ------------------------------------------------------------------ BPE
def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    docs = awkward(spark).select("doc_id", "text").union(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"))
    texts = [r["text"] or "" for r in docs.collect()]
    want = Counter()
    for e in library.encode_batch(texts, add_special_tokens=False):
        ids = np.array(e.ids, "<u4").tobytes()
        want[len(e.ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = Counter((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(docs, digest=True).collect())
    assert got == want
    assert bpe.encode_documents(empty(spark)).count() == 0


def test_bpe_fuzz():
    import random

    from tokenizers import Tokenizer

    random.seed(11)
    own, library = bpe.encoder(bpe.vocabulary_path()), Tokenizer.from_file(bpe.vocabulary_path())
    letters = [*"abcXYZ '’s019.,<|>éÀß日本ΣςİıﬁKÅ　 \x1c\x00\x85\t\n‍🙂ñ́", "'s", "'LL", "<|endoftext|>", "  ", "don't"]
    texts = ["".join(random.choices(letters, k=random.randint(0, 50))) for _ in range(1500)]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_bpe_forgets_without_changing_results(monkeypatch):
    own = bpe.ForcedBoundaryBPE(bpe.vocabulary_path())
    texts = [f"word{k} other{k % 7}!".encode() for k in range(300)]
    whole = own.encode(texts)
    own.chunks.most = own.fragments[True].most = own.fragments[False].most = 20
    assert [own.encode([t])[0] for t in texts] == whole


# ------------------------------------------------------------------ sharding
def test_shards_are_even_gapless_and_reproducible(spark):
    for df in (spark.read.parquet(f"{DATA}/documents.parquet"), awkward(spark)):
        out = sharding.shard(df).toPandas()
        counts = out.groupby("shard").size()
        assert counts.max() - counts.min() <= 1 and len(counts) == 8
        for _, rows in out.groupby("shard"):
            assert sorted(rows.slot) == list(range(len(rows)))
        again = sharding.shard(df.repartition(7)).toPandas()
        key = ["doc_id", "size", "text_crc32", "shard", "slot"]
        assert out[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert sharding.shard(empty(spark)).count() == 0


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 100, 1000])
def test_permutation_is_one(spark, rows):
    image = sharding.permute(spark.range(rows), "id", rows, 5)
    assert sorted(r["id"] for r in image.collect()) == list(range(rows))


def test_shard_checksums(spark):
    for r in sharding.shard(spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string")).collect():
        raw = {1: "é", 2: ""}[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))


# ------------------------------------------------------------------ quality
def test_quality_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op5_boosted_quality(spark, sf).toPandas()
    assert len(out) == 1000 and ((out.score >= 0) & (out.score <= 1)).all() and (out.predicted == (out.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(out.doc_id, out.held_out, strict=True))
    both = out[out.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert len(both) > 80 and (both.predicted == both.quality).mean() >= 0.97


def test_quality_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (8, None), (None, 1), (77, 1), (9, 7)], "doc_id long, quality int")
    forest = quality.train(docs, labels)
    out = quality.score_documents(docs, forest).collect()
    assert len(out) == 12 and all(0 <= r["score"] <= 1 for r in out)
    assert quality.keep_good(docs, forest).columns == docs.columns
    nothing = quality.train(empty(spark), labels.where("false"))
    assert {r["score"] for r in quality.score_documents(docs, nothing).collect()} == {0.5}
    assert quality.score_documents(empty(spark), nothing).count() == 0


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.1)).astype(float)
    forest = quality.fit(x, y, trees=20, depth=3)
    logit = np.full(len(x), forest.base)
    for i, row in enumerate(x):
        for root in forest.roots:
            node = root
            while forest.low[node] != node:
                node = forest.low[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.high[node]
            logit[i] += forest.value[node]
    assert np.allclose(forest.scores(x), 1 / (1 + np.exp(-logit)))
    assert ((forest.scores(x) >= 0.5) == y).mean() > 0.95


# ------------------------------------------------------------------ media
def test_media_round_trip(spark):
    docs = awkward(spark).select("doc_id", "text")
    read = mjpeg.read_media(mjpeg.write_media(docs))
    want = Counter()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        padded = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        want[r["doc_id"], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])] += 1
    rows = read.collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert mjpeg.clips(read).groupBy("doc_id").sum("frames").count() == len({r["doc_id"] for r in rows})
    assert mjpeg.read_media(mjpeg.write_media(empty(spark))).count() == 0


def test_frames_of_all_bytes():
    rng = np.random.default_rng(4)
    frames = rng.integers(0, 256, (300, mjpeg.FRAME)).astype(np.uint8)
    frames[0], frames[1], frames[2] = 0, 255, np.tile([0, 255], mjpeg.FRAME // 2)
    data, offsets = mjpeg.encode_frames(frames)
    assert (mjpeg.decode_frames(data, offsets[:-1], offsets[1:]) == frames).all()
    avi = mjpeg.write_avis(frames, np.array([300]))[0]
    starts, stops = mjpeg.frame_places(avi)
    assert (mjpeg.decode_frames(np.frombuffer(avi, np.uint8), starts, stops) == frames).all()
    with pytest.raises(ValueError):
        mjpeg.frame_places(b"RIFF0000WAVE")


def test_shots_are_cut_where_content_changes():
    dark, light = np.full((12, mjpeg.FRAME), 20, np.uint8), np.full((9, mjpeg.FRAME), 230, np.uint8)
    noise = np.random.default_rng(0).integers(0, 3, (21, mjpeg.FRAME)).astype(np.uint8)
    starts = mjpeg.shot_starts(np.concatenate([dark, light]) + noise, np.array([21]))
    assert [s.tolist() for s in starts] == [[0, 12]]


def test_texts_of_a_shared_id_link_their_copies(spark):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "red green blue black white grey")
    rows = [(5, a), (10, a), (10, b), (6, b), (20, c), (21, c), (30, a + " x")]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # 10 has the texts of 5 and of 6, and is the least id of neither class
    assert got == {(5, 5), (10, 5), (6, 5), (20, 20), (21, 20), (30, 30)}
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [5, 20, 30]


def test_rows_of_one_id_and_text_are_kept_alike_by_every_run(spark):
    rows = [(1, "some words of a text here", k) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source int")
    picks = {minhash.keep_one(docs.repartition(n)).collect()[0].source for n in (1, 3, 7)}
    assert len(picks) == 1


def test_mix_orders_texts_of_one_id_and_size(spark):
    docs = spark.createDataFrame([(1, w * 3, "s") for w in ("a ", "b ", "c ", "d ", "e ")], "doc_id long, text string, source string")
    runs = {tuple(r.text for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 2, 5)}
    assert len(runs) == 1
