"""Reproducible sharding by a Feistel permutation of global row numbers.

Row numbers follow the order of ids. A Feistel network over the grid ``a x b`` of
least size that holds all rows permutes them; a value past the last row walks on
along its cycle until it falls inside. Shard and slot are the remainder and the
quotient of the permuted number, so shards differ by one row at most, slots have no
gap, and either can be computed for any row number alone. Expressions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.storage import stage_table

#: A prime below 2^31: products of two residues stay within 64 bits.
PRIME = 2_147_483_647
ROUNDS = 4
ROWS_PER_RANGE = 200_000


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Multiplier and addend of every round, from the seed by a linear congruence."""
    state, keys = seed % PRIME, []
    for _ in range(ROUNDS):
        pair = []
        for _ in range(2):
            state = (state * 48_271 + 11) % PRIME
            pair.append(state or 1)
        keys.append((pair[0], pair[1]))
    return keys


def grid(rows: int) -> tuple[int, int]:
    """Sides of the least near-square grid with ``rows`` cells or more."""
    a = max(1, math.isqrt(max(0, rows - 1)) + 1)
    return a, max(1, -(-rows // a))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; plain nesting would double the expression at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scramble(x: Column, key: tuple[int, int]) -> Column:
    once = (x * F.lit(key[0]) + F.lit(key[1])) % F.lit(PRIME)
    return let(once, lambda v: (v * v + v * F.lit(key[1]) % F.lit(PRIME)) % F.lit(PRIME))


def _left(key: tuple[int, int], a: int) -> Callable[[Column], Column]:
    return lambda h: F.struct(((h.l + _scramble(h.r, key)) % a).alias("l"), h.r.alias("r"))


def _right(key: tuple[int, int], b: int) -> Callable[[Column], Column]:
    return lambda h: F.struct(h.l.alias("l"), ((h.r + _scramble(h.l, key)) % b).alias("r"))


def feistel(number: Column, rows: int, seed: int) -> Column:
    """The image of a number below a*b."""
    a, b = grid(rows)
    halves = F.struct((number % a).alias("l"), F.call_function("div", number, F.lit(a)).alias("r"))
    for i, key in enumerate(round_keys(seed)):
        halves = let(halves, _right(key, b) if i % 2 else _left(key, a))
    return let(halves, lambda h: h.r * a + h.l)


def walked(spark: SparkSession, rows: int, seed: int) -> DataFrame:
    """Where each number past the last row comes out inside along its cycle: ``_past, _inside``, fewer than ``a`` rows.

    Each step is written before the next, so the plan does not grow with the walk.
    """
    a, b = grid(rows)
    table = spark.range(rows, a * b).select(F.col("id").alias("_past"), F.col("id").alias("_inside"))
    while not table.where(F.col("_inside") >= rows).isEmpty():
        step = F.when(F.col("_inside") >= rows, feistel(F.col("_inside"), rows, seed)).otherwise(F.col("_inside"))
        table = stage_table(table.select("_past", step.alias("_inside")), "walk")
    return table


def permute(df: DataFrame, column: str, rows: int, seed: int) -> DataFrame:
    """``column``, global row numbers 0 to rows - 1, replaced by their places in the shuffle."""
    if not rows:
        return df
    image = df.withColumn(column, feistel(F.col(column), rows, seed))
    # the walk's table has fewer rows than the square root of the rows, and one more
    image = image.join(F.broadcast(walked(df.sparkSession, rows, seed)), F.col(column) == F.col("_past"), "left")
    return image.withColumn(column, F.coalesce("_inside", column)).drop("_past", "_inside")


def number_rows(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """``_row``: gapless global row numbers from 0 in the order of the columns.

    Range partitions are sorted and written once with their places; their sizes, one
    number for each partition, give the offsets. Equal rows are dealt by a random
    number, which changes nothing: they are interchangeable.
    """
    parts = max(1, -(-rows // ROWS_PER_RANGE))
    ranged = df.withColumn("_tie", F.rand(7)).repartitionByRange(max(parts, 32 if rows > 10_000 else 1), *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = ranged.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    table = stage_table(placed.select(*df.columns, part.alias("_part"), place.alias("_place")), "numbered")
    sizes = table.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    # one row for each range partition
    return table.join(F.broadcast(ahead), "_part").withColumn("_row", F.col("_ahead") + F.col("_place")).drop("_part", "_place", "_ahead")


def shard(docs: DataFrame, shards: int = 8, seed: int = 20_240_229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every document: ``doc_id, size, text_crc32, row, shard, slot``.

    Size is the text's UTF-8 bytes and one more; a null text counts as empty. Rows of
    one id are ordered by size and checksum; a null id comes first; equal rows are
    interchangeable. An empty table has an empty result; other columns are ignored.
    """
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    narrow = stage_table(narrow, "docs")
    rows = narrow.count()
    numbered = number_rows(narrow, ["doc_id", "size", "text_crc32"], rows)
    out = permute(numbered.withColumn("_to", F.col("_row")), "_to", rows, seed)
    return out.select("doc_id", "size", "text_crc32", F.col("_row").alias("row"), (F.col("_to") % shards).cast("int").alias("shard"), F.expr(f"_to div {int(shards)}").cast("long").alias("slot"))


def op9_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 8 shards under the law of rows: counts differ by one at most."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _op9_sql(shards: int = 8, seed: int = 20_240_229) -> str:
    k = round_keys(seed)

    def scramble(x: str, key: tuple[int, int]) -> str:
        once = f"(({x} * {key[0]} + {key[1]}) % {PRIME})"
        return f"(({once} * {once} + {once} * {key[1]} % {PRIME}) % {PRIME})"

    return f"""
WITH RECURSIVE bits AS (
  SELECT range AS i, range AS c, 0 AS step FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
  CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS BIGINT) AS text_crc32 FROM documents, tab),
n AS (SELECT count(*) AS n, greatest(1, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS a FROM documents),
g AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM n),
r AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS i FROM d),
walk AS (
  SELECT i, i AS x, 0 AS step FROM r
  UNION ALL SELECT i, r2 * a + l2, step + 1 FROM (
    SELECT *, (r1 + {scramble("l2", k[3])}) % b AS r2 FROM (
      SELECT *, (l1 + {scramble("r1", k[2])}) % a AS l2 FROM (
        SELECT *, (r0 + {scramble("l1", k[1])}) % b AS r1 FROM (
          SELECT *, (l0 + {scramble("r0", k[0])}) % a AS l1 FROM (
            SELECT i, step, a, b, x % a AS l0, x // a AS r0 FROM walk, g WHERE step = 0 OR x >= n)))))
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, CAST(x // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN (SELECT i, x FROM walk, g WHERE step > 0 AND x < n) USING (i)
"""


OP9_SQL = _op9_sql()
