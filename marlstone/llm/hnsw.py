"""Approximate nearest neighbours by cosine: one navigable small-world hierarchy for each shard.

Rows are dealt to shards by their global number, so copies of a hot vector spread. A
shard's equal vectors are one node with several ids. Its nodes stand in a pseudo-random
order of which layer ``l`` holds the first ``n / 16^l``: each layer is a flat array of
neighbour numbers, a row for each node. The layers are grown from the top one down, a
batch of nodes at a time: a batch is searched for in what stands already, neighbours
are picked so that none is nearer to a picked one than to the node, and links are
made in both directions. The index is a written table, a row for each shard.

A query descends greedily to the lowest layer and widens there to a beam. What all
shards find is scored in double precision on the original vectors and merged.
All searches of a batch go side by side in numpy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.sharding import number_rows
from marlstone.llm.storage import stage_table

#: Neighbours of a node in the lowest layer and above it; nodes of a layer for one of the next.
LOW, HIGH, THIN = 32, 16, 16
#: Widths of the beam while the graph grows and while queries are answered.
GROWING, ASKING = 48, 128
#: Nodes of the topmost layer at most; nodes added at once; queries answered at once; nodes opened at once.
TOP, BATCH, AT_ONCE, OPENED = 64, 512, 256, 4
#: A shard has LEAST_ROWS rows at least (but for small tables) and MOST_ROWS, or MOST_BYTES of vectors, at most; between these, SPREAD shards are
#: made. Work falls with larger shards, and so does recall: README gives figures.
LEAST_ROWS, SPREAD, MOST_ROWS, MOST_BYTES = 2048, 64, 16_384, 64 << 20
#: Bytes of vectors in one block of queries.
QUERY_BYTES = 64 << 20
_INDEX = "_shard int, width int, nodes int, ids binary, ends binary, vectors binary, layers array<binary>, loose binary"
_FOUND = "query_id long, vec_id long, score double"


def _units(vectors: np.ndarray) -> np.ndarray:
    """Directions in single precision; scaled by powers of two first, so that no square leaves the doubles."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1][:, None])
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with that of ``b``, in double precision."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None]) for x in (a, b))
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _beam(x: np.ndarray, links: np.ndarray, asked: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes met from ``entry`` on, for each row of ``asked``: numbers (-1 where fewer) and similarities, nearest first."""
    rows = len(asked)
    seen = np.zeros((rows, len(links)), bool)
    ids = np.full((rows, width), -1, np.int32)
    near = np.full((rows, width), -np.inf, np.float32)
    opened = np.zeros((rows, width), bool)
    everyone = np.arange(rows)
    ids[:, 0], near[:, 0] = entry, np.einsum("rd,rd->r", x[entry], asked)
    seen[everyone, entry] = True
    live = everyone
    while len(live):
        waiting = np.where(opened[live], -np.inf, near[live])
        places = np.argsort(-waiting, axis=1)[:, :OPENED]
        open_now = np.take_along_axis(waiting, places, 1) > -np.inf
        some = open_now.any(axis=1)
        live, places, open_now = live[some], places[some], open_now[some]
        if not len(live):
            break
        opened[live[:, None], places] |= open_now
        at = np.where(open_now, ids[live[:, None], places], -1)
        met = np.where((at >= 0)[:, :, None], links[at], -1).reshape(len(live), -1)
        # a node that several opened ones link to counts once
        met = np.sort(met, axis=1)
        met[:, 1:][met[:, 1:] == met[:, :-1]] = -1
        fresh = (met >= 0) & ~seen[live[:, None], met]
        seen[live[:, None], np.where(fresh, met, entry[live][:, None])] = True
        r, c = np.nonzero(fresh)
        similar = np.full(met.shape, -np.inf, np.float32)
        similar[r, c] = np.einsum("rd,rd->r", x[met[r, c]], asked[live[r]])
        all_near = np.concatenate([near[live], similar], axis=1)
        best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        near[live] = np.take_along_axis(all_near, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, met, -1)], axis=1), best, 1)
        opened[live] = np.take_along_axis(np.concatenate([opened[live], ~fresh], axis=1), best, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def _descend(x: np.ndarray, layers: list[np.ndarray], asked: np.ndarray, most: int) -> np.ndarray:
    """A node below ``most`` near each row of ``asked``: the best of the first ``TOP``, then greedily through the layers given, topmost first."""
    here = np.argmax(asked @ x[: min(TOP, most, *(len(links) for links in layers[:1]))].T, axis=1)
    for links in layers:
        near = np.einsum("rd,rd->r", x[here], asked)
        live = np.arange(len(asked))
        while len(live):
            met = links[here[live]]
            similar = np.einsum("rcd,rd->rc", x[met], asked[live])
            similar[(met < 0) | (met >= most)] = -np.inf
            best = similar.argmax(axis=1)
            gain = similar[np.arange(len(live)), best]
            better = gain > near[live]
            live, best, gain, met = live[better], best[better], gain[better], met[better]
            here[live], near[live] = met[np.arange(len(live)), best], gain
    return here


def _pick(x: np.ndarray, cand: np.ndarray, similar: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` neighbours of each row's candidates (-1: none): those nearer to the node than to any picked before, then the nearest of the rest."""
    order = np.argsort(np.where(cand < 0, np.inf, -similar), axis=1, kind="stable")
    cand, similar = np.take_along_axis(cand, order, 1), np.take_along_axis(similar, order, 1)
    there = cand >= 0
    v = x[cand]
    among = v @ v.transpose(0, 2, 1)
    picked = np.zeros(cand.shape, bool)
    closest = np.full(cand.shape, -np.inf, np.float32)  # of each candidate, to those picked
    for c in range(cand.shape[1]):
        take = there[:, c] & (closest[:, c] < similar[:, c]) & (picked.sum(axis=1) < most)
        picked[:, c] = take
        closest[take] = np.maximum(closest[take], among[take, c])
    first = np.argsort(np.where(picked, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(cand, first, 1)


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Every link of the nodes ``new`` in the other direction too; a node with too many picks again."""
    width = links.shape[1]
    to, by = links[new].reshape(-1), np.repeat(new, width)
    to, by = to[to >= 0], by[to >= 0]
    similar = np.einsum("rd,rd->r", x[to], x[by])
    order = np.lexsort((-similar, to))
    to, by, similar = to[order], by[order], similar[order]
    nodes, begin, count = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(begin, count)
    row = np.repeat(np.arange(len(nodes)), count)
    incoming = np.full((len(nodes), width), -1, links.dtype)
    keep = place < width
    incoming[row[keep], place[keep]] = by[keep]
    incoming[(incoming[:, :, None] == links[nodes][:, None, :]).any(axis=2)] = -1
    for some in np.array_split(np.arange(len(nodes)), len(nodes) // 1024 + 1):
        both = np.concatenate([links[nodes[some]], incoming[some]], axis=1)
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        full = both[:, width] >= 0
        links[nodes[some[~full]]] = both[~full, :width]
        if full.any():
            these = nodes[some[full]]
            links[these] = _pick(x, both[full], np.einsum("rcd,rd->rc", x[both[full]], x[these]), width)


def _grow(x: np.ndarray, count: int, above: list[np.ndarray], width: int) -> np.ndarray:
    """The layer of the first ``count`` nodes."""
    links = np.full((count, width), -1, np.int32)
    begin = 0
    while begin < count:
        stop = min(count, begin + min(BATCH, max(TOP, begin)))
        new = np.arange(begin, stop, dtype=np.int32)
        among = x[new] @ x[new].T
        np.fill_diagonal(among, -np.inf)
        near = np.argsort(-among, axis=1, kind="stable")[:, :width]
        cand, similar = new[near], np.take_along_axis(among, near, 1)
        cand = np.where(similar > -np.inf, cand, -1)
        if begin:
            found = [_beam(x, links[:begin], x[new[k : k + AT_ONCE]], _descend(x, above, x[new[k : k + AT_ONCE]], begin), GROWING) for k in range(0, len(new), AT_ONCE)]
            cand = np.concatenate([np.concatenate([f[0] for f in found]), cand], axis=1)
            similar = np.concatenate([np.concatenate([f[1] for f in found]), similar], axis=1)
        links[new, : width // 2] = _pick(x, cand, similar, width // 2) if cand.shape[1] >= width // 2 else np.pad(cand, ((0, 0), (0, width // 2 - cand.shape[1])), constant_values=-1)
        _link_back(x, links, new)
        begin = stop
    return links


def grow_layers(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Neighbour arrays of all layers, topmost first, over unit vectors in pseudo-random order, and the nodes that cannot be reached from the first."""
    counts = [len(x)]
    while counts[-1] > TOP * 2:
        counts.append(counts[-1] // THIN)
    layers: list[np.ndarray] = []
    for depth, count in reversed(list(enumerate(counts))):
        layers.append(_grow(x, count, list(layers), LOW if depth == 0 else HIGH))
    reached = np.zeros(len(x), bool)
    edge = np.zeros(min(1, len(x)), np.int64)
    reached[edge] = True
    while len(edge):
        edge = np.unique(layers[-1][edge])
        edge = edge[edge >= 0]
        edge = edge[~reached[edge]]
        reached[edge] = True
    return layers, np.flatnonzero(~reached).astype(np.int32)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of doubles, shorter vectors ended by zeros."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), width))
    out[np.repeat(np.arange(len(flat)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def _build(width: int, kind: str) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        shard, ids = rows["_shard"][0].as_py(), rows["vec_id"].to_numpy()
        vectors = _matrix(rows["vector"], width)
        nodes, owner = np.unique(vectors, axis=0, return_inverse=True)
        # a pseudo-random order of nodes that reruns repeat
        rank = np.random.default_rng(len(nodes)).permutation(len(nodes))
        nodes, owner = nodes[np.argsort(rank)], rank[owner.reshape(-1)]
        order = np.lexsort((ids, owner))
        ends = np.cumsum(np.bincount(owner, minlength=len(nodes)))
        layers, loose = grow_layers(_units(nodes))
        columns = [[shard], [width], [len(nodes)], [ids[order].tobytes()], [ends.tobytes()], [nodes.astype(kind).tobytes()], [[a.tobytes() for a in layers]], [loose.tobytes()]]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary()]
        names = ["_shard", "width", "nodes", "ids", "ends", "vectors", "layers", "loose"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _layers(index: dict) -> list[np.ndarray]:
    widths = [HIGH] * (len(index["layers"]) - 1) + [LOW]
    return [np.frombuffer(a, np.int32).reshape(-1, w) for a, w in zip(index["layers"], widths, strict=True)]


def search_shard(index: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest rows that a shard's graph finds for each query: query ids, row ids, cosines."""
    vectors = np.frombuffer(index["vectors"], kind).reshape(index["nodes"], index["width"])
    ids, ends, loose = (np.frombuffer(index[c], t) for c, t in (("ids", np.int64), ("ends", np.int64), ("loose", np.int32)))
    layers, x = _layers(index), _units(vectors.astype(np.float64))
    begins = np.append(0, ends[:-1])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(queries), AT_ONCE):
        asked = queries[start : start + AT_ONCE]
        met, _ = _beam(x, layers[-1], _units(asked), _descend(x, layers[:-1], _units(asked), len(x)), beam)
        if len(loose):
            met = np.concatenate([met, np.where((loose[None, :, None] == met[:, None, :]).any(axis=2), -1, loose)], axis=1)
        r, c = np.nonzero(met >= 0)
        node = met[r, c]
        score = cosines(vectors[node].astype(np.float64), asked[r])
        # a node stands for all rows of its vector, of which the least k ids and the query's own can count
        times = np.minimum(ends[node] - begins[node], k + 1)
        at = np.repeat(begins[node], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        r, score, vec = np.repeat(r, times), np.repeat(score, times), ids[at]
        own = vec == query_ids[start + r]
        r, score, vec = r[~own], score[~own], vec[~own]
        order = np.lexsort((vec, -score, r))
        r, score, vec = r[order], score[order], vec[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((query_ids[start + r[best]], vec[best], score[best]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _ask(k: int, beam: int, width: int, kind: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(index) or not len(queries):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])
        found = search_shard(index.to_pylist()[0], queries["vec_id"].to_numpy(), _matrix(queries["vector"], width), k, beam, kind)
        return pa.table([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    return run


def sound_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, vector``: rows with an id and a vector that is neither null nor zero and holds finite components only."""
    vector = F.col(vec_col)
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))


def build_index(table: DataFrame, rows: int, width: int) -> DataFrame:
    """The written index of a table of ``sound_vectors``: a row for each shard."""
    most = max(1, min(MOST_ROWS, MOST_BYTES // (8 * width)))
    shards = max(1, -(-rows // most), min(SPREAD, -(-rows // LEAST_ROWS)))
    numbered = number_rows(table.withColumn("_tie_hash", F.xxhash64("vector")), ["vec_id", "_tie_hash"], rows)
    dealt = numbered.select((F.col("_row") % shards).cast("int").alias("_shard"), "vec_id", "vector")
    return stage_table(dealt.groupBy("_shard").applyInArrow(_build(width, _kind(table)), _INDEX), "graphs")


def _kind(table: DataFrame) -> str:
    """The components' type in the index: single precision where the column has it."""
    return "float32" if "float" in dict(table.dtypes)["vector"] else "float64"


def nearest(vectors: DataFrame, k: int = 5, query_every: int = 50, beam: int = ASKING, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows by cosine that the graphs find for each query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``query_every``, candidates all rows but those of the query's
    own id; ties go to the smaller id. Vectors that are null, zero or hold a null or non-finite component, and rows
    without an id, take no part. A shorter vector counts as ended by zeros. Repeated rows are candidates as
    often as they occur; of query rows that share an id, the least vector asks. Fewer than ``k`` candidates
    are all returned (of a query whose own id has ``beam`` different vectors or more in a shard, those found beside them).
    An empty table has an empty result; other columns are ignored. Every row is indexed. A shard and a block of
    queries meet in one task, both bounded in bytes; the work is that of all queries over all shards.
    """
    spark = vectors.sparkSession
    table = stage_table(sound_vectors(vectors.select(id_col, vec_col), id_col, vec_col), "vectors")
    size = table.agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("width")).first()
    rows, width = size["rows"], size["width"] or 1
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = build_index(table, rows, width)
    # each side gets the blocks of the other: both counts are small numbers known by arithmetic
    asking = table.where(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asking = stage_table(asking, "queries")
    blocks = max(1, -(-asking.count() * 8 * width // QUERY_BYTES))
    shards = index.count()
    asking = asking.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    graphs = index.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = graphs.groupBy("_shard", "_part").cogroup(asking.groupBy("_of", "_block")).applyInArrow(_ask(k, beam, width, _kind(table)), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_shard_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, against all embeddings: the 5 nearest found."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
