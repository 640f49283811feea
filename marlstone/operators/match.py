"""Joins that match records: validated, best-unique, voting, by whole keys, by templates. Similar names are in ``similar``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def join_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join; a key that the right side has twice raises while the join runs."""
    counted = right.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c not in keys])
    checked = counted.where(F.coalesce(F.assert_true(F.col("_n") == 1, "the right side repeats a key"), F.lit(True))).drop("_n")
    return left.join(checked, list(keys), "left")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which both sides must have the same keys, each once; all else raises."""
    a = left.groupBy(*keys).agg(F.count("*").alias("_a"), *[F.first(c).alias(c) for c in left.columns if c not in keys])
    b = right.groupBy(*keys).agg(F.count("*").alias("_b"), *[F.first(c).alias(c) for c in right.columns if c not in keys])
    both = a.join(b, list(keys), "full")
    ok = (F.col("_a") == 1) & (F.col("_b") == 1)
    return both.where(F.coalesce(F.assert_true(F.coalesce(ok, F.lit(False)), "the sides do not match one to one"), F.lit(True))).drop("_a", "_b")


def best_unique(rows: DataFrame, candidates: DataFrame, block: Sequence[str], fields: Sequence[str], ident: str, found: str, least: int = 2) -> DataFrame:
    """For each row (``ident``) the candidate (``found``) of its block that agrees in most non-null fields, where that is ``least`` or more and only one has it.

    Candidates of equal fields stand together: as one, if alone, else as several that rule each other out. A row meets those
    that share some ``least`` of its fields, by an index of all choices of so many fields.
    """
    shapes = candidates.groupBy(*block, *fields).agg(F.min(found).alias("_lo"), F.max(found).alias("_hi")).withColumn("_other", F.struct(*fields)).drop(*fields)
    asking = rows.select(*block, *fields).distinct().withColumn("_own", F.struct(*fields)).drop(*fields)

    def indexed(side: DataFrame, whole: str) -> DataFrame:
        parts = [F.when(reduce(and_, [F.col(f"{whole}.{f}").isNotNull() for f in c]), F.struct(F.lit(k).alias("k"), F.to_json(F.struct(*[F.col(f"{whole}.{f}") for f in c])).alias("v"))) for k, c in enumerate(combinations(fields, least))]
        return side.withColumn("_at", F.explode(F.array_compact(F.array(*parts))))

    same = [(F.col(f"_own.{f}") == F.col(f"_other.{f}")) for f in fields]
    met = indexed(asking, "_own").join(indexed(shapes, "_other"), [*block, "_at"])
    # a pair meets at each choice that agrees: it counts at the first
    first = F.coalesce(*[F.when(reduce(and_, [F.coalesce(same[fields.index(f)], F.lit(False)) for f in c]), F.lit(k)) for k, c in enumerate(combinations(fields, least))])
    met = met.where(F.col("_at.k") == first).withColumn("_score", sum((F.coalesce(x.cast("int"), F.lit(0)) for x in same), F.lit(0)))
    tops = met.groupBy(*block, "_own", "_score").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    best = tops.groupBy(*block, "_own").agg(F.max(F.struct("_score", "_lo", "_hi")).alias("_b")).where("_b._lo = _b._hi")
    return rows.withColumn("_own", F.struct(*fields)).join(best, [*block, "_own"]).select(ident, F.col("_b._lo").alias(found), F.col("_b._score").alias("score"))


def vote(scores: DataFrame, ident: str, option: str, score: str, least: float) -> DataFrame:
    """Scores added up by option: the strict winner of each ident, if any single score reaches ``least``."""
    sums = scores.groupBy(ident, option).agg(F.sum(score).alias("_sum"), F.max(score).alias("_best"))
    # the greatest sum by its least and by its greatest option: one option where they agree
    ends = [F.max_by(F.struct(option), F.struct("_sum", option)).alias("_hi"), F.min_by(F.struct(option), F.struct((-F.col("_sum")).alias("_down"), option)).alias("_lo")]
    ranked = sums.groupBy(ident).agg(F.max("_sum").alias("_top"), F.max("_best").alias("_one"), *ends)
    return ranked.where((F.col("_one") >= least) & (F.col("_hi") == F.col("_lo"))).select(ident, F.col(f"_hi.{option}").alias(option), F.col("_top").alias("score"))


def unique_by_key(rows: DataFrame, evidence: DataFrame, keys: Sequence[str], ident: str, found: str) -> DataFrame:
    """For each row the one ``found`` that the evidence has for its whole key; rows with several or none are left out."""
    ones = evidence.groupBy(*keys).agg(F.min(found).alias("_lo"), F.max(found).alias("_hi")).where("_lo = _hi")
    return rows.join(ones, list(keys)).select(ident, F.col("_lo").alias(found))


def preferred(df: DataFrame, key: str, name: str, demoted: Column, order: str) -> DataFrame:
    """For each key the first name in order that is not demoted, else the first of all."""
    return df.where(F.col(name).isNotNull()).groupBy(key).agg(F.min_by(name, F.struct(demoted, F.col(order))).alias(name))


def canonical(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """For each key the spelling to use: code-like first, then with + or -, then the shortest, then by alphabet."""
    code = ~F.col(name).rlike(r"^[A-Za-z]*[0-9-][A-Za-z0-9-]*$")
    signed = ~F.col(name).rlike(r"[+-]")
    order = F.struct(code.alias("a"), signed.alias("b"), F.length(name).alias("c"), F.lower(name).alias("d"), F.col(name).alias("e"))
    return df.groupBy(*keys).agg(F.min_by(name, order).alias("canonical"))


def inherit_from_template(df: DataFrame, template: Column, prefix: Column, columns: Sequence[str], block: Sequence[str]) -> DataFrame:
    """Rows of a template (``template`` true) lend their values to the rows of their block with the same prefix; a template with such a row goes."""
    marked = df.withColumn("_t", template).withColumn("_p", prefix)
    keys = [*block, "_p"]
    lent = marked.where("_t").groupBy(*keys).agg(*[F.min(c).alias(f"_l_{c}") for c in columns])
    owned = marked.where("not _t").select(*keys).distinct().withColumn("_has", F.lit(True))
    kept = marked.where("_t").join(owned, keys, "left").where("_has is null").drop("_has")
    filled = marked.where("not _t").join(lent, keys, "left").withColumns({c: F.coalesce(c, f"_l_{c}") for c in columns})
    return filled.select(*df.columns).unionByName(kept.select(*df.columns))
