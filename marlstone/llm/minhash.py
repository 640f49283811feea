"""Near-duplicate documents by one-permutation hashing.

One pass over the texts gives every document the fingerprint of its shingle set
and the bands of its one-permutation signature (empty bins densified by optimal
densification). Documents of one shingle set form a class, of which one stands
in. In each band bucket the representatives get star-shaped candidate edges to
the bucket's least one, its hub, so candidates stay linear in the bucket.

Each representative is first compared with one hub, on full sets; confirmed links are contracted
to components. What is left are buckets that hold several components: there every pair
of different components is compared, in blocks of bounded size, and each task yields only
a spanning forest of the links that hold. So all pairs that share a bucket are linked
or known to be unlike; no bucket, cluster or partner count is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.heavy import join_by_key
from marlstone.llm.shingles import mix64, raw_bytes, shingle_sets, text_slices
from marlstone.llm.storage import small_batches, stage_table
from marlstone.operators.graph import connected_components

#: Bins of a signature (a power of two), rows of a band. 25 bands of 5 rows miss a pair of similarity 0.85
#: once in about two million, of 0.8 once in about twenty thousand.
BINS, ROWS = 128, 5
#: Documents and shingles of a block when the rest of a bucket is compared; leaves of a hub in one job; columns of a product.
BLOCK, BLOCK_SHINGLES, LEAVES, COLUMNS = 384, 400_000, 1024, 4096
SLICE = 500_000


def signatures(hashes: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation signature of every non-empty set: its least hash in each bin (the top bits), densified.

    An empty bin probes bins in an order that depends on the bin and the attempt alone, until it meets a filled one.
    """
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = (hashes >> shift).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
    out = np.zeros((len(sizes), bins), np.uint64)
    filled = np.zeros((len(sizes), bins), bool)
    out[owner[first], place[first]] = hashes[first]
    filled[owner[first], place[first]] = True
    rows, gaps = np.nonzero(~filled & (sizes > 0)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        probe = (mix64(gaps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = filled[rows, probe]
        out[rows[hit], gaps[hit]] = out[rows[hit], probe[hit]]
        rows, gaps = rows[~hit], gaps[~hit]
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of every band of every signature; the band's number is part of the key."""
    count = signature.shape[1] // rows
    keys = np.zeros((len(signature), count), np.uint64)
    for r in range(rows):
        keys = mix64(keys + signature[:, r : count * rows : rows][:, :count] * np.uint64(0xD6E8FEB86659FD93))
    return mix64(keys + np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _fingerprints(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(4).cast(pa.string())
            for start, stop in text_slices(column, SLICE):
                hashes, offsets = shingle_sets(*raw_bytes(column.slice(start, stop - start)))
                sizes = np.diff(offsets)
                # sums over a set; an empty one has 0
                sums = [np.append(np.cumsum(x), np.uint64(0)) for x in (hashes, mix64(hashes ^ np.uint64(0xA0761D6478BD642F)))]
                prints = [(np.where(offsets[1:] > 0, s[offsets[1:] - 1], 0) - np.where(offsets[:-1] > 0, s[offsets[:-1] - 1], 0)).astype(np.uint64) for s in sums]
                keys = band_keys(signatures(hashes, offsets), rows)
                keys = keys[sizes > 0]
                ends = np.append(0, np.cumsum(np.where(sizes > 0, keys.shape[1], 0))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(start, stop - start) for k in range(4)), pa.array(sizes.astype(np.int64)), *(pa.array(p.view(np.int64)) for p in prints), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))],
                    ["doc_id", "node", "h1", "h2", "n_shingles", "f1", "f2", "bands"],
                )

    return run


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``left`` with those at ``right``, by products of 0/1 matrices over the shingles that several sets have."""
    lengths = np.array([len(s) for s in sets])
    values, flat, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1
    column = np.cumsum(shared) - 1
    keep = shared[flat]
    owner, flat = np.repeat(np.arange(len(sets)), lengths)[keep], column[flat[keep]]
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    out = np.zeros((len(left), len(right)))
    for begin in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(flat, [begin, begin + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[lo:hi], flat[lo:hi] - begin] = 1
        out += has[left] @ has[right].T
    return out


def _forest(sets: list[np.ndarray], nodes: list[int], side: np.ndarray, comps: list[int], threshold: int) -> list[tuple[int, int]]:
    """Links ``100 * intersection >= threshold * union`` between different components, of which only those that join two; with two sides only links across."""
    lengths = np.array([len(s) for s in sets])
    two = side.min() != side.max()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(sets)),) * 2
    parent = np.unique(comps, return_inverse=True)[1].tolist()
    if len(set(parent)) == 1:
        return []
    both = _common(sets, left, right)
    whole = lengths[left][:, None] + lengths[right][None, :] - both
    mixed = np.array(parent)
    linked = (100 * both >= threshold * whole) & (mixed[left][:, None] != mixed[right][None, :])
    head = list(range(max(parent) + 1))

    def top(k: int) -> int:
        while head[k] != k:
            head[k] = head[head[k]]
            k = head[k]
        return k

    out = []
    for i, j in np.argwhere(linked).tolist():
        a, b = int(left[i]), int(right[j])
        x, y = top(parent[a]), top(parent[b])
        if x != y:
            head[x] = y
            out.append((nodes[a], nodes[b]))
    return out


def _sets(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Each row's place and shingle set, the text being the column of that number."""
    for batch in batches:
        column = batch.column(text).cast(pa.string())
        for start, stop in text_slices(column, SLICE):
            hashes, offsets = shingle_sets(*raw_bytes(column.slice(start, stop - start)))
            for k in range(start, stop):
                yield batch, k, hashes[offsets[k - start] : offsets[k - start + 1]]


def _verify_stars(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``hub, chunk, leaf, node, text`` sorted by the first three: each leaf against its hub's set. One set is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, hubs, found, last = None, [], [], None
        for batch, k, own in _sets(batches, 4):
            if batch is not last:
                if found:
                    yield _edges(found)
                names, found, last = [batch.column(c).to_pylist() for c in range(4)], [], batch
            hub, chunk, leaf, node = (names[c][k] for c in range(4))
            if (hub, chunk) != job:
                job, hubs = (hub, chunk), []
            if not leaf:
                # rows of one id may have several texts; equal ones count once
                if not any(len(h) == len(own) and (h == own).all() for h in hubs):
                    hubs.append(own.copy())
                continue
            for h in hubs:
                both = len(np.intersect1d(h, own, assume_unique=True))
                if 100 * both >= threshold * (len(h) + len(own) - both):
                    found.append((hub, node))
                    break
        yield _edges(found)

    return run


def _verify(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``band, main, lo, hi, node, side, comp, text`` sorted by job, the first four; a job is two blocks or one and so bounded."""

    def job(rows: list[tuple]) -> list[tuple[int, int]]:
        return _forest([r[3] for r in rows], [r[0] for r in rows], np.array([r[1] for r in rows]), [r[2] for r in rows], threshold) if len(rows) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, last = None, [], None
        for batch, k, own in _sets(batches, 7):
            if batch is not last:
                names = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
                members, last = list(zip(*(batch.column(c).to_pylist() for c in (4, 5, 6)), strict=True)), batch
            if names[k] != now:
                if rows:
                    yield _edges(job(rows))
                now, rows = names[k], []
            rows.append((*members[k], own.copy()))
        yield _edges(job(rows) if rows else [])

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = [pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(ends, ["a", "b"])


def _found(docs: DataFrame, threshold: int, id_col: str, text_col: str, rows: int) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, h1, h2`` (hashes of the text), ``n_shingles``, ``root`` (its component's least node, null without words) and ``component_id``."""
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    # nodes are numbers: a whole-number id is its own, any other or none a hash
    whole = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    node = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(2), "doc_id"))
    source = source.withColumn("node", F.coalesce(node, "h1"))
    schema = f"doc_id {dict(source.dtypes)['doc_id']}, node long, h1 long, h2 long, n_shingles long, f1 long, f2 long, bands array<long>"
    prints = stage_table(source.select("doc_id", "node", "h1", "h2", "text").mapInArrow(_fingerprints(rows), schema), "prints")
    key = ["n_shingles", "f1", "f2"]
    classes = prints.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.min("node").alias("node"), F.any_value("bands").alias("bands"))
    classes = stage_table(classes, "classes")
    linked = _links(source.select("node", "text"), classes, _shared_ids(prints, classes), threshold)
    named = classes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select(*key, "root", "component_id")
    return prints.drop("node", "bands").join(named, key, "left").select("doc_id", "h1", "h2", "n_shingles", "root", "component_id")


def _shared_ids(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``a, b`` between the representatives of classes that hold different texts of one id."""
    spark, key = prints.sparkSession, ["n_shingles", "f1", "f2"]
    rows = prints.where("n_shingles > 0")
    several = rows.groupBy("node").agg(F.min(F.struct(*key)).alias("_lo"), F.max(F.struct(*key)).alias("_hi"), F.count("*").alias("_n")).where("_lo <> _hi").select("node", "_lo", "_n")
    several = stage_table(several, "shared-ids")
    if several.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    met = join_by_key(rows.select("node", *key), several, ["node"], "_n", rows.count()).select(*key, "_lo").distinct().where(F.struct(*key) != F.col("_lo"))
    met = met.join(classes.select(*key, F.col("node").alias("a")), key).select("a", "_lo.*")
    return stage_table(met.join(classes.select(*key, F.col("node").alias("b")), key).select("a", "b").where("a <> b"), "shared-ids")


def _links(source: DataFrame, classes: DataFrame, known: DataFrame, threshold: int) -> DataFrame:
    """Components (``node, root``) of the classes' representatives under confirmed and ``known`` links."""
    banded = classes.select("node", "n_shingles", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("far"), F.count("*").alias("n")).where("hub <> far").drop("far")
    rows = classes.select(F.sum(F.size("bands"))).first()[0] or 0
    placed = stage_table(join_by_key(banded, stage_table(buckets, "buckets"), ["band"], "n", rows), "banded")
    # a star edge for each representative: to the least hub of its buckets
    stars = stage_table(placed.groupBy("node").agg(F.min("hub").alias("hub")), "stars")
    candidates = stage_table(source.join(stars.hint("merge"), "node").select("node", "hub", "text"), "candidates")
    leaves = candidates.where("node <> hub")
    chunks = stars.where("node <> hub").groupBy("hub").agg(F.ceil(F.count("*") / LEAVES).alias("chunks"), F.count("*").alias("n"))
    chunks = stage_table(chunks, "chunks")
    own = join_by_key(leaves, chunks, ["hub"], "n", leaves.count()).select("hub", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), F.lit(True).alias("leaf"), "node", "text")
    hubs = candidates.select("node", "text").join(chunks.select(F.col("hub").alias("node"), "chunks").hint("merge"), "node")
    hubs = hubs.select(F.col("node").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("leaf"), "node", "text")
    jobs = hubs.unionByName(own).repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "leaf", "node")
    links = stage_table(jobs.mapInArrow(_verify_stars(threshold), "a long, b long").unionByName(known), "links")
    first = connected_components(links, "a", "b")
    rest = _rest(placed, stars, first, candidates, threshold)
    return connected_components(links.unionByName(rest), "a", "b")


def _rest(placed: DataFrame, stars: DataFrame, first: DataFrame, candidates: DataFrame, threshold: int) -> DataFrame:
    """Links between the components that share a bucket: ``a, b``."""
    comps = stars.select("node", F.col("hub").alias("tried")).join(first, "node", "left").select("node", "tried", F.coalesce("root", "node").alias("comp"))
    members = stage_table(placed.select("node", "n_shingles", "band").join(comps.hint("merge"), "node"), "members")
    # of each bucket: its components, and what its least member, whose component is the main one, was compared with
    found = members.groupBy("band").agg(
        F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("n"), F.min("node").alias("hub"), F.min_by("comp", "node").alias("main"), F.max_by("tried", "node").alias("tried"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("_sum"),
    )
    # a pair that was compared needs no second look, nor does a set of members that another bucket has as well
    found = found.where("_lo <> _hi and not (n = 2 and tried = hub)").groupBy("n", "_sum").agg(F.min(F.struct("band", "main")).alias("_b")).select("_b.*", "n")
    found = stage_table(found, "open")
    total = members.count()
    rows = stage_table(join_by_key(members, found, ["band"], "n", total).withColumn("is_main", F.col("comp") == F.col("main")), "open-members")
    blocks = rows.groupBy("band", "is_main").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("_blocks"))
    blocks = blocks.groupBy("band").agg(F.coalesce(F.max(F.when(F.col("is_main"), F.col("_blocks"))), F.lit(0)).alias("mains"), F.coalesce(F.max(F.when(~F.col("is_main"), F.col("_blocks"))), F.lit(0)).alias("others"))
    sizes = stage_table(rows.groupBy("band").agg(F.count("*").alias("n")).join(blocks, "band"), "blocks")
    rows = join_by_key(rows, sizes, ["band"], "n", rows.count())
    block = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others")))

    def every(n: str) -> Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))

    rows = rows.withColumn("block", block)
    # members of the main component meet the others; the others meet one another too
    across = F.transform(every("mains"), lambda k: F.struct(F.lit(True).alias("with_main"), F.col("block").alias("lo"), k.alias("hi"), F.lit(0).alias("side")))
    among = F.transform(every("others"), lambda k: F.struct(F.lit(False).alias("with_main"), F.least(k, F.col("block")).alias("lo"), F.greatest(k, F.col("block")).alias("hi"), (F.col("block") > k).cast("int").alias("side")))
    mains = F.transform(every("others"), lambda k: F.struct(F.lit(True).alias("with_main"), k.alias("lo"), F.col("block").alias("hi"), F.lit(1).alias("side")))
    jobs = rows.select("band", "node", "comp", F.inline(F.when(F.col("is_main"), mains).otherwise(F.concat(across, among))))
    jobs = candidates.select("node", "text").join(jobs.hint("merge"), "node").select("band", "with_main", "lo", "hi", "node", "side", "comp", "text")
    jobs = jobs.repartition("band", "with_main", "lo", "hi").sortWithinPartitions("band", "with_main", "lo", "hi", "node")
    return jobs.mapInArrow(_verify(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """Component of every document under links of Jaccard similarity ``threshold`` percent or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a document's set is its
    distinct five-word shingles, or its whole word sequence if it has fewer words.
    Returns ``doc_id, n_shingles, component_id, kept``, one row for each input row.

    Ids are whole numbers or strings. Null, empty and wordless texts have an empty set and are linked with nothing.
    Rows that share an id are one document (its texts are linked). Rows with a null
    id take part through their text; where no linked row has an id, component_id is
    null and the row is kept. An empty table has an empty result; other columns are
    ignored. Links rest on 64-bit hashes of shingles.
    """
    found = _found(docs, threshold, id_col, text_col, rows)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``: that of the least id, of rows of this id that of the least hash of the text.

    Rows without an id are no exception: a component of such rows alone keeps one of
    them, any other none. Of equal rows one stays. Rows without words are linked with
    nothing and all stay.
    """
    found = stage_table(_found(docs, threshold, id_col, text_col, rows), "found")
    place = F.struct(F.col("doc_id").isNull().alias("_none"), F.col("doc_id").alias("_of"), F.col("h1").alias("_k1"), F.col("h2").alias("_k2"))
    first = found.where("root is not null").groupBy("root").agg(F.min(place).alias("_p")).select("_p.*").drop("_none")
    texts = F.col(text_col).cast("string")
    silent = F.coalesce(~texts.rlike(r"[^ \t-\r]"), F.lit(True))
    speaking = docs.where(~silent).select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(texts).alias("_h1"), F.xxhash64(F.lit(1), texts).alias("_h2"))
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2"))
    stay = speaking.join(first.hint("merge"), same, "left_semi")
    # of rows with one id and text the one whose other columns have the least hash, by partial aggregates
    others = [F.col("_row")[c] for c, kind in docs.dtypes if "map<" not in kind]
    stay = stay.groupBy("_id", "_h1", "_h2").agg(F.min_by("_row", F.struct(F.xxhash64(*others).alias("a"), F.xxhash64(F.lit(1), *others).alias("b"))).alias("_row")).select("_row.*")
    return stay.unionByName(docs.where(silent))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents at 85 percent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
