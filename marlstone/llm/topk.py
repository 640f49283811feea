"""Exact top-k inner products by norm buckets.

Vectors are turned into whole numbers and grouped into buckets of like length, the
longest first. Each query's scores in the longest bucket give a floor for its k-th
score. In every other bucket the floor over the product of the lengths is the cosine
a candidate must reach there: above 1 the bucket is passed over for this query;
where it is high, a few of the query's largest coordinates confine the candidates'
coordinates; where it is low, length alone prunes. What is left is multiplied out.
A bucket is a block of bounded size, cut from one sorted order, so a hot length or
vector fills several. Queries are blocked by the length they need of a candidate: a
block of queries then reaches a run of buckets from the longest on, and a bucket is
sent to those blocks of queries alone that reach it. No pair of rows is a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.sharding import number_rows
from marlstone.llm.storage import stage_table

#: Rows of a candidate block and of a query block, and queries multiplied at once.
BLOCK, QUERIES, AT_ONCE = 8192, 4096, 512
#: From this local cosine threshold on, coordinates prune; below it, lengths do.
HIGH, FOCUS = 0.5, 3
_FOUND = "query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, ints, norm2``: components ``floor(scale * x)``; vectors that are null or hold null or non-finite components are left out.

    Components beyond 2^53 are no exact doubles and are kept as the double's whole value; one of 2^62 or more is an error.
    """
    double = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    sound = F.col(vec_col).isNotNull() & F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    much = F.raise_error(F.lit("a scaled component of 2^62 or more")).cast("long")
    ints = F.transform(double, lambda x: F.when(F.abs(x * F.lit(float(scale))) < float(1 << 62), F.floor(x * F.lit(float(scale))).cast("long")).otherwise(much))
    out = vectors.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("ints"))
    return out.withColumn("norm2", F.aggregate("ints", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    if all(len(v) == width for v in column):
        return np.array(column.tolist(), dtype=np.int64).reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; doubles where they are exact, since these multiply faster. A product past 64 bits is an OverflowError."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return a @ b.T
    whole = a.astype(object) @ b.astype(object).T
    if whole.size and (whole.max() >= 1 << 63 or whole.min() < -(1 << 63)):
        raise OverflowError("an inner product does not fit 64 bits")
    return whole.astype(np.int64)


def best_in_block(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best candidates of a block for each query, those under the query's floor left out."""
    width = max(queries["ints"].map(len).max(), block["ints"].map(len).max())
    block = block.sort_values("norm2", ascending=False, kind="stable")
    c, ids = _matrix(block["ints"], width), block["vec_id"].to_numpy()
    lengths = np.sqrt(block["norm2"].to_numpy())
    unit = c / np.maximum(lengths, 1e-300)[:, None]
    q_all, q_ids = _matrix(queries["ints"], width), queries["vec_id"].to_numpy()
    q_len = np.sqrt(queries["norm2"].to_numpy())
    floors = queries["floor"].to_numpy(dtype=np.float64) if "floor" in queries else np.full(len(queries), np.nan)
    local = np.where(q_len > 0, floors / np.maximum(q_len * lengths[0], 1e-300), -np.inf)
    # a threshold of at most 0 (or none) prunes nothing: one product for all such queries
    plain = ~(local > 0)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    bound = float(np.abs(q_all).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, width)
    doubles = (q_all.astype(np.float64), c.astype(np.float64)) if bound < 2**53 else None
    slack = 1e-9

    def multiply(some: np.ndarray | list[int], at: np.ndarray | slice) -> np.ndarray:
        return _products(q_all[some], c[at]) if doubles is None else doubles[0][some] @ doubles[1][at].T

    def keep(q: int, at: np.ndarray, scores: np.ndarray) -> None:
        if not np.isnan(floors[q]):
            over = np.flatnonzero(scores >= floors[q])
            at, scores = at[over], scores[over]
        ok = ids[at] != q_ids[q]
        at, scores = at[ok], scores[ok].astype(np.int64)
        if len(at) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[scores >= edge], scores[scores >= edge]
            order = np.lexsort((ids[at], -scores))[:k]
            at, scores = at[order], scores[order]
        parts.append((np.full(len(at), q_ids[q]), ids[at], scores))

    # how many of the longest candidates a query may meet: all, or those of |v| >= floor / |q|
    need = np.where(plain, 0, floors / np.maximum(q_len, 1e-300))
    reach = np.where(plain, len(ids), np.searchsorted(-lengths, -need * (1 - slack), side="right"))
    reach[~plain & (local > 1 + slack)] = 0
    together = []
    for q in np.flatnonzero(reach):
        if local[q] < HIGH or plain[q]:
            together.append(q)
            continue
        # a unit vector within the threshold t of unit q has its coordinate f in q_f*t -+ sqrt((1-t^2)(1-q_f^2))
        at = np.arange(reach[q])
        direction = q_all[q] / q_len[q]
        t = min(1.0, local[q])
        for f in np.argsort(-np.abs(direction))[:FOCUS]:
            spread = np.sqrt(max(0.0, (1 - t * t) * (1 - direction[f] ** 2))) + slack
            low = direction[f] * t - spread if -direction[f] < t else -1 - slack
            high = direction[f] * t + spread if direction[f] < t else 1 + slack
            x = unit[at, f]
            at = at[(x >= low) & (x <= high)]
        if len(at) * 8 > reach[q]:
            together.append(q)  # coordinates say little here: multiplied along with the others
        elif len(at):
            keep(q, at, multiply([q], at)[0])
    together = np.array(together, int)
    together = together[np.argsort(reach[together], kind="stable")]
    everyone = np.arange(len(ids))
    for begin in range(0, len(together), AT_ONCE):
        some = together[begin : begin + AT_ONCE]
        for q, scores in zip(some, multiply(some, slice(0, reach[some[-1]])), strict=True):
            keep(q, everyone[: reach[q]], scores[: reach[q]])
    if not parts:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    columns = [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def _meet(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return best_in_block(queries, block.rename(columns={"_vec_id": "vec_id", "_ints": "ints", "_norm2": "norm2"}), k)

    return run


def _against(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """``queries`` (a row for each ``_b`` that the block ``_q`` of queries meets) against ``blocks`` (a row for each ``_q`` that meets them)."""
    # fresh columns on either side: both stem from one table
    candidates = blocks.select(F.col("_b").alias("_b2"), F.col("_q").alias("_q2"), *[F.col(c).alias(f"_{c}") for c in ("vec_id", "ints", "norm2")])
    asked = queries.select("_b", "_q", *[F.expr(f"{c} as {c}") for c in queries.columns if c not in ("_b", "_q")])
    return asked.groupBy("_b", "_q").cogroup(candidates.groupBy("_b2", "_q2")).applyInPandas(_meet(k), _FOUND)


def _blocked(table: DataFrame, rows: int, most: int, order: list[str], name: str) -> DataFrame:
    """The table in blocks of ``most`` rows (the last has fewer), numbered from 0 in ``order``."""
    numbered = number_rows(table, order, rows).withColumn(name, F.floor(F.col("_row") / most).cast("int")).drop("_row")
    return stage_table(numbered, "blocks")


def _reached(blocks: DataFrame, asking: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each block of queries the number of blocks it reaches (``_q, _blocks``), and for each block that of the blocks of queries which reach it (``_b, _asking``).

    Both are runs from the first on, since blocks come by falling length and blocks of queries by rising need:
    counts along one order, over as many rows as there are blocks.
    """
    longest = blocks.groupBy("_b").agg((F.sqrt(F.max("norm2")) * (1 + 1e-9)).alias("_at"))
    needs = asking.groupBy("_q").agg(F.min("_need").alias("_at"))
    both = longest.select("_at", F.lit(1).alias("_is_block"), F.col("_b").alias("_n")).unionByName(needs.select("_at", F.lit(0).alias("_is_block"), F.col("_q").alias("_n")))
    falling = Window.orderBy(F.desc("_at"), F.desc("_is_block")).rowsBetween(Window.unboundedPreceding, 0)
    rising = Window.orderBy("_at", "_is_block").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_before", F.sum("_is_block").over(falling)).withColumn("_under", F.sum(1 - F.col("_is_block")).over(rising))
    return both.where("_is_block = 0").select(F.col("_n").alias("_q"), F.col("_before").alias("_blocks")), both.where("_is_block = 1").select(F.col("_n").alias("_b"), F.col("_under").alias("_asking"))


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products of each query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``query_every``, candidates all rows but
    those of the query's own id; ties go to the smaller id. Vectors that are null or hold a
    null or non-finite component, and rows without an id, take no part. A shorter vector
    counts as ended by zeros; one without components scores 0. Repeated rows are
    candidates as often as they occur; of query rows that share an id, the least vector asks. A score past
    64 bits is an error. Fewer than ``k`` candidates are all returned; an
    empty table has an empty result; other columns are ignored.
    """
    table = stage_table(whole_vectors(vectors.select(id_col, vec_col), scale, id_col, vec_col), "vectors")
    rows = table.count()
    queries = table.where(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id").agg(F.min(F.struct("ints", "norm2")).alias("_v")).select("vec_id", "_v.*")
    queries = stage_table(queries, "queries")
    asked = queries.count()
    # equal lengths are parted by id; the first block holds the longest vectors
    blocks = _blocked(table.withColumn("_short", -F.col("norm2")), rows, BLOCK, ["_short", "vec_id"], "_b").drop("_short")
    first, rest = blocks.where("_b = 0"), blocks.where("_b > 0")
    # the floor: the k-th score in the first block, which meets every block of queries
    parts = max(1, -(-asked // QUERIES))
    q = queries.select(F.lit(0).alias("_b"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("_q"), "*")
    seeds = _against(q, first.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), k)
    seeds = stage_table(_top(seeds, k), "seeds")
    floors = seeds.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor")).dropDuplicates(["vec_id"])
    need = F.when((F.col("floor") > 0) & (F.col("norm2") > 0), F.col("floor") / F.sqrt("norm2")).otherwise(0.0)
    asking = _blocked(queries.join(floors, "vec_id", "left").withColumn("_need", need), asked, QUERIES, ["_need", "vec_id"], "_q")
    reach, asked_by = _reached(rest, asking)
    # a block of queries meets the blocks 1 to its last; a block meets the blocks of queries 0 to its last
    meets = reach.where("_blocks > 0").select("_q", F.explode(F.sequence(F.lit(1), F.col("_blocks").cast("int"))).alias("_b"))
    likes = asked_by.where("_asking > 0").select("_b", F.explode(F.sequence(F.lit(0), F.col("_asking").cast("int") - 1)).alias("_q"))
    found = _against(asking.join(meets, "_q").drop("_need"), rest.join(likes, "_b"), k)
    every = seeds.select("query_id", "vec_id", "score").unionByName(found)
    return _top(every, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20, against all embeddings: 20 best."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
