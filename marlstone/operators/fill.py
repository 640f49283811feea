"""Conservative filling: a blank takes a value only where the evidence has one.

Aggregated once by key (map-side first) and joined back, so a hot key is a few
partial rows in the aggregation and is split in the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def unique_value(c: Column) -> Column:
    """Aggregate: the one distinct non-null value, else null."""
    return F.when(F.min(c) == F.max(c), F.min(c))


def _back(df: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = found.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in found.columns if c not in keys])
    on = [df[k].eqNullSafe(found[f"_k_{k}"]) for k in keys]
    return df.join(found, on, "left").drop(*[f"_k_{k}" for k in keys])


def _counted(df: DataFrame, columns: Sequence[str], found: str, observation: Observation | None) -> DataFrame:
    """``df`` as it is; the observation gets ``rows`` and, for each column, ``filled_`` it: nulls for which ``found`` has a value. Read it once the result is written."""
    if observation is None:
        return df
    return df.observe(observation, F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull() & F.col(f"{found}{c}").isNotNull()).alias(f"filled_{c}") for c in columns])


def fill_unique(df: DataFrame, keys: Sequence[str], columns: Sequence[str], observation: Observation | None = None) -> DataFrame:
    """Nulls of ``columns`` take the one value their key group has; groups of none or several stay. An ``observation`` counts what the step fills."""
    found = df.groupBy(*keys).agg(*[unique_value(F.col(c)).alias(f"_u_{c}") for c in columns])
    out = _counted(_back(df, found, keys), columns, "_u_", observation)
    return out.withColumns({c: F.coalesce(c, f"_u_{c}") for c in columns}).drop(*[f"_u_{c}" for c in columns])


def strict_mode(df: DataFrame, keys: Sequence[str], column: str, name: str, least: int = 1) -> DataFrame:
    """For each key the most frequent value of a column, null on a tie or in groups of fewer than ``least`` rows."""
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("_n"))
    there = F.col(column).isNotNull()
    # the greatest count by its first and by its last value: one value where they agree
    ends = [F.max(F.when(there, F.struct("_n", column))).alias("_hi"), F.min(F.when(there, F.struct((-F.col("_n")).alias("_down"), column))).alias("_lo")]
    tops = counts.groupBy(*keys).agg(F.sum("_n").alias("_rows"), *ends)
    value = F.when((F.col("_hi")[column] == F.col("_lo")[column]) & (F.col("_rows") >= least), F.col("_hi")[column])
    return tops.select(*keys, value.alias(name))


def fill_mode(df: DataFrame, keys: Sequence[str], columns: Sequence[str], least: int = 1) -> DataFrame:
    """Nulls take their group's strict mode."""
    for c in columns:
        df = _back(df, strict_mode(df, keys, c, "_mode", least), keys).withColumn(c, F.coalesce(c, "_mode")).drop("_mode")
    return df


def fill_levels(df: DataFrame, levels: Sequence[Sequence[str]], columns: Sequence[str], least: int = 2) -> DataFrame:
    """Strict modes at one level of keys after the other; a later level sees what the earlier has filled."""
    for keys in levels:
        df = fill_mode(df, keys, columns, least)
    return df


def fill_lookup(df: DataFrame, evidence: DataFrame, levels: Sequence[tuple[str, Sequence[str]]], columns: Sequence[str]) -> DataFrame:
    """Nulls take the evidence's value at the first level where it is unique; ``<column>_source`` names that level.

    ``levels``: (name, key columns present on both sides), the most specific first.
    """
    for c in columns:
        df = df.withColumn(f"{c}_source", F.lit(None).cast("string"))
    for name, keys in levels:
        found = evidence.groupBy(*keys).agg(*[unique_value(F.col(c)).alias(f"_u_{c}") for c in columns])
        df = _back(df, found, keys)
        for c in columns:
            filled = F.col(c).isNull() & F.col(f"_u_{c}").isNotNull()
            df = df.withColumn(f"{c}_source", F.when(filled, F.lit(name)).otherwise(F.col(f"{c}_source"))).withColumn(c, F.coalesce(c, f"_u_{c}")).drop(f"_u_{c}")
    return df


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Nulls take the last non-null value before them in the order of their key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def audit(before: DataFrame, after: DataFrame, ident: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A row for each value that a fill has put in: ``ident``, ``field``, ``value``."""
    old = before.select(*ident, *[F.col(c).cast("string").alias(f"_o_{c}") for c in columns])
    new = after.select(*ident, *[F.col(c).cast("string").alias(f"_n_{c}") for c in columns])
    both = new.join(old, list(ident))
    found = F.array(*[F.struct(F.lit(c).alias("field"), F.when(F.col(f"_o_{c}").isNull(), F.col(f"_n_{c}")).alias("value")) for c in columns])
    return both.select(*ident, F.explode(found).alias("_f")).where("_f.value is not null").select(*ident, "_f.*")
