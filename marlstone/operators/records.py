"""Record reconciliation: first-wins dedup, collapse to one row, placeholders, guards, greedy merging."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType


def first_wins(df: DataFrame, keys: Sequence[Column | str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def number_occurrences(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1, 2, 3 ... for the rows of each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def collapse(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """One row for each key: the fullest row (most non-nulls, then most text, then first) is the anchor, its nulls are filled from the next fullest.

    Aggregated by ``min_by`` of the rank for each column, so partial results are one value for each column and key.
    """
    full = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    size = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0))
    ranked = df.withColumn("_rank", F.struct((-full).alias("a"), (-size).alias("b"), F.col(order).alias("c")))
    picks = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in columns]
    return ranked.groupBy(*keys).agg(*picks, F.min_by(order, "_rank").alias(order), F.count("*").alias("merged_rows"))


def placeholder_ids(df: DataFrame, block: str, signature: Sequence[str], ident: str, order: str, prefix: str = "UNRESOLVED") -> DataFrame:
    """Rows without an id get ``PREFIX_<block>_<nnn>``, one number for each signature of the block in first-seen order."""
    blank = df.where(F.col(ident).isNull())
    first = blank.groupBy(block, *signature).agg(F.min(order).alias("_first"))
    numbered = first.withColumn("_n", F.row_number().over(Window.partitionBy(block).orderBy("_first")))
    numbered = numbered.select(*[F.col(c).alias(f"_s_{c}") for c in (block, *signature)], "_n")
    on = [df[c].eqNullSafe(numbered[f"_s_{c}"]) for c in (block, *signature)] + [df[ident].isNull()]
    tag = F.concat(F.lit(prefix + "_"), F.substring(F.regexp_replace(F.col(block).cast("string"), "[^A-Za-z0-9]", ""), 1, 12), F.lit("_"), F.lpad(F.col("_n").cast("string"), 3, "0"))
    return df.join(numbered, on, "left").withColumn(ident, F.coalesce(ident, tag)).select(*df.columns)


def clear_where_sibling(df: DataFrame, family: Sequence[str], base: Column, modified: Column, columns: Sequence[str]) -> DataFrame:
    """Fields of base rows are cleared where their family has a modified sibling."""
    has = df.withColumn("_m", modified).groupBy(*family).agg(F.max("_m").alias("_has"))
    out = df.withColumn("_b", base).join(has, list(family), "left")
    guard = F.col("_b") & F.coalesce("_has", F.lit(False))
    return out.withColumns({c: F.when(~guard, F.col(c)) for c in columns}).select(*df.columns)


def lattice_max(df: DataFrame, keys: Sequence[str], column: str, ranks: Sequence[str]) -> DataFrame:
    """For each key the class that stands highest; ``ranks`` lists classes from the lowest."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col(column))
    return df.groupBy(*keys).agg(F.max(rank).alias("_r")).select(*keys, F.get(F.array(*[F.lit(r) for r in ranks]), (F.col("_r") - 1).cast("int")).alias(column))


class _Kept:
    """Kept rows by what they know, so that the first one that a row does not contradict is looked up.

    Rows that know the same fields lie together. A row agrees with such a row if both have equal values in the fields that both
    know, which is a key; whether that is enough depends on these fields alone. A row that learns a field moves on, and
    what the indexes still say of it is passed over.
    """

    def __init__(self, block: Sequence[str], columns: Sequence[str], cues: frozenset, least: int) -> None:
        self.fields = [*dict.fromkeys([*block, *columns])]
        self.block, self.signs, self.least = frozenset(block), frozenset(columns) & cues, least
        self.rows: list[dict] = []
        self.knows: list[frozenset] = []
        self.having: dict[frozenset, list[int]] = {}
        self.index: dict[frozenset, dict[tuple, dict[tuple, list[int]]]] = {}

    def known(self, row: dict) -> frozenset:
        return frozenset(c for c in self.fields if row[c] is not None)

    def enough(self, both: frozenset) -> bool:
        return self.block <= both or len(both & self.signs) >= self.least

    def first(self, row: dict) -> int | None:
        own, best = self.known(row), None
        for knows, members in self.having.items():
            both = own & knows
            if not self.enough(both):
                continue
            at = tuple(c for c in self.fields if c in both)
            found = self.index[knows].get(at)
            if found is None:
                found = self.index[knows][at] = {}
                for k in members:
                    if self.knows[k] == knows:
                        heappush(found.setdefault(_values(self.rows[k], at), []), k)
            heap = found.get(_values(row, at), [])
            while heap and self.knows[heap[0]] != knows:
                heappop(heap)
            if heap and (best is None or heap[0] < best):
                best = heap[0]
        return best

    def place(self, k: int) -> None:
        row, knows = self.rows[k], self.knows[k]
        self.having.setdefault(knows, []).append(k)
        for at, found in self.index.setdefault(knows, {}).items():
            heappush(found.setdefault(_values(row, at), []), k)

    def add(self, row: dict) -> None:
        self.rows.append(row)
        self.knows.append(self.known(row))
        self.place(len(self.rows) - 1)

    def fill(self, k: int, row: dict) -> None:
        kept = self.rows[k]
        for c in self.fields:
            if kept[c] is None:
                kept[c] = row[c]
        now = self.known(kept)
        if now != self.knows[k]:
            self.knows[k] = now
            self.place(k)


def _values(row: dict, at: tuple) -> tuple:
    return tuple(repr(v) if isinstance(v, (list, dict)) else v for v in (row[c] for c in at))


def greedy_merge(df: DataFrame, paper: str, block: Sequence[str], columns: Sequence[str], order: str, least: int = 2, cues: Sequence[str] | None = None) -> DataFrame:
    """Within each paper every row joins the first kept row that it does not contradict, else it is kept.

    Rows with an empty block field need ``least`` equal values (of ``cues``, if given) with the kept row. The result depends on
    the order of rows, hence one pass for each paper over rows in order; kept rows are looked up by
    the values that both know, so a row costs as much as there are sets of known fields, not as kept rows.
    """
    fields = [*block, *columns]
    out_columns = [paper, *fields, order, "merged_rows"]
    signs = frozenset(columns if cues is None else cues)

    def merge(rows: list[dict]) -> list[dict]:
        kept = _Kept(block, columns, signs, least)
        for row in rows:
            hit = kept.first(row)
            if hit is None:
                kept.add(row | {"merged_rows": 1})
            else:
                kept.fill(hit, row)
                kept.rows[hit]["merged_rows"] += 1
        return kept.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by paper and order; a paper may go over several batches."""
        own: list[dict] = []
        for batch in batches:
            done: list[dict] = []
            for row in batch.to_pylist():
                if own and own[0][paper] != row[paper]:
                    done += merge(own)
                    own = []
                own.append(row)
            yield pa.RecordBatch.from_pylist(done, schema=target)
        yield pa.RecordBatch.from_pylist(merge(own), schema=target)

    source = df.select(paper, *fields, order)
    schema = StructType([*source.schema.fields, StructField("merged_rows", LongType())])
    target = to_arrow_schema(StructType([StructField(f.name, f.dataType) for f in schema.fields]))
    return source.repartition(paper).sortWithinPartitions(paper, order).mapInArrow(run, schema).select(*out_columns)


def label_histogram(df: DataFrame, labels: str, none: str = "(none)") -> DataFrame:
    """``label, n``: rows by label, each row once for every distinct label it has; those without any under ``none``."""
    own = F.array_distinct(F.array_compact(F.coalesce(F.col(labels), F.array().cast("array<string>"))))
    # bound first: written out, the labels would be computed for the condition and for the value
    bound = F.get(F.transform(F.array(own), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(none)))), F.lit(0))
    each = df.select(F.explode(bound).alias("label"))
    return each.groupBy("label").agg(F.count("*").alias("n"))


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that a table lacks, in the order wanted."""
    return [c for c in wanted if c not in df.columns]


def require_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The table with its wanted columns alone, rows without any value left out; a missing column is a ValueError."""
    lacking = missing_columns(df, wanted)
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df.select(*wanted).na.drop("all")
