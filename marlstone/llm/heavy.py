"""Joins against one row for each key where single keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it has at least this share of all rows; so there are no more than ``HEAVY`` heavy keys.
HEAVY = 10_000


def join_by_key(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join (``inner``, or ``left`` for all rows) of ``rows`` with ``keyed``, a written table that has one row for each key and the number ``count`` of the rows with it.

    Keys with ``total / HEAVY`` rows or more are at most ``HEAVY`` by arithmetic
    (their counts add up to no more than ``total``, the number of ``rows``): a hash of each tells the rows
    that have them, which are joined where they lie with the few rows of these keys. All other keys are small
    and meet by a shuffle. ``count`` is dropped.
    """
    least = max(2, -(-total // HEAVY))
    known = [r[0] for r in keyed.where(F.col(count) >= least).select(F.xxhash64(*keys)).collect()]  # at most HEAVY numbers
    plain = keyed.drop(count)
    if not known:
        return rows.join(plain.hint("merge"), keys, how)
    heavy = F.xxhash64(*keys).isin(known)
    here = rows.where(heavy).join(F.broadcast(plain.where(heavy)), keys, how)
    return here.unionByName(rows.where(~heavy).join(plain.where(~heavy).hint("merge"), keys, how))
