"""Similarity joins of names inside blocks, without comparing all pairs of a block.

Equal forms are joined once, however many rows have them. Candidates come from an index:

* containment: what is contained has all its 3-grams in the container, so its rarest
  one in the block leads to all containers;
* token sets: with tokens ordered from the rarest to the commonest, two sets of
  sufficient overlap share a token among their first few (the prefix filter);
* suffixes: the suffixes of the longer name are the index.

A token or gram with many entries is split: its entries lie in slots of bounded size and
what looks them up goes to each slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T

#: Letters of a gram; entries of one key that lie together.
GRAM, TOGETHER = 3, 2000


def _grams(c: Column, size: int) -> Column:
    """Distinct substrings of a length; none of a shorter text."""
    at = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(size))))


def _look_up(asking: DataFrame, entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on ``keys``, of whose entries no more than about ``TOGETHER`` lie in one group; the other side is repeated for each group."""
    many = entries.groupBy(*keys).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("_slots")).where("_slots > 1")
    spread = entries.join(many, list(keys), "left").withColumn("_slot", F.when(F.col("_slots").isNull(), 0).otherwise(F.pmod(F.xxhash64(*entries.columns), F.col("_slots"))).cast("int")).drop("_slots")
    repeated = asking.join(many, list(keys), "left").withColumn("_slot", F.explode(F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1))).drop("_slots")
    return repeated.join(spread, [*keys, "_slot"]).drop("_slot")


def contained(needles: DataFrame, hays: DataFrame, block: Sequence[str], needle: str, hay: str) -> DataFrame:
    """All pairs of a block in which the text ``needle``, not empty, is part of the text ``hay``: the columns of both sides, of which only those of the block may share a name."""
    index = hays.select(*block, hay).distinct().select(*block, hay, F.explode(F.concat(*[_grams(F.col(hay), n) for n in range(1, GRAM + 1)])).alias("_gram"))
    often = index.groupBy(*block, "_gram").agg(F.count("*").alias("_n"))
    wanted = needles.select(*block, needle).where(F.length(needle) > 0).distinct()
    own = F.when(F.length(needle) >= GRAM, _grams(F.col(needle), GRAM)).otherwise(F.array(needle))
    wanted = wanted.select(*block, needle, F.explode(own).alias("_gram")).join(often, [*block, "_gram"], "left")
    # a gram that the index lacks rules the needle out
    rarest = wanted.groupBy(*block, needle).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r")).where("_r.n > 0").select(*block, needle, F.col("_r._gram").alias("_gram"))
    pairs = _look_up(rarest, index, [*block, "_gram"]).where(F.contains(hay, needle)).select(*block, needle, hay)
    return pairs.join(needles, [*block, needle]).join(hays, [*block, hay])


def _by_rarity(sets: DataFrame, block: Sequence[str], ident: str, items: str, often: DataFrame) -> DataFrame:
    """``sets`` with ``_s``, the items from the rarest in the block to the commonest."""
    each = sets.select(*block, ident, F.explode(items).alias("_item")).join(often, [*block, "_item"])
    ordered = each.groupBy(*block, ident).agg(F.sort_array(F.collect_list(F.struct("_n", "_item"))).alias("_o"))  # as long as the set
    return ordered.select(*block, ident, F.transform("_o", lambda x: x["_item"]).alias("_s"))


def overlapping(left: DataFrame, right: DataFrame, block: Sequence[str], a: str, b: str, items_a: str, items_b: str, jaccard: float | None = None, shared: int | None = None) -> DataFrame:
    """``block, a, b, both, total``: pairs of sets (identified by ``a`` and ``b`` in their block) that share ``shared`` items or more, or whose Jaccard similarity is ``jaccard`` or more, with the sizes of intersection and union. Items of a set are distinct."""
    every = left.select(*block, F.explode(items_a).alias("_item")).unionByName(right.select(*block, F.explode(items_b).alias("_item")))
    often = every.groupBy(*block, "_item").agg(F.count("*").alias("_n"))

    def prefix(items: Column) -> Column:
        n = F.size(items)
        # a set in a sufficient pair shares at least so many of its own items; with fewer left out, one of them is met
        least = F.lit(shared) if shared is not None else F.greatest(F.ceil(n * F.lit(jaccard) - F.lit(1e-9)), F.lit(1)).cast("int")
        return F.when(n >= least, F.slice(items, F.lit(1), F.greatest(n - least + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))

    sides = [_by_rarity(s, block, i, c, often).select(*block, F.col(i), F.col("_s").alias(f"_s_{k}"), prefix(F.col("_s")).alias(f"_p_{k}")) for k, (s, i, c) in enumerate(((left, a, items_a), (right, b, items_b)))]
    asking, entries = (s.withColumn("_item", F.explode(f"_p_{k}")) for k, s in enumerate(sides))
    met = _look_up(asking, entries, [*block, "_item"])
    # a pair meets at each item that both prefixes have: it counts at the first
    met = met.where(F.get(F.array_intersect("_p_0", "_p_1"), F.lit(0)) == F.col("_item"))
    both = F.size(F.array_intersect("_s_0", "_s_1"))
    out = met.withColumn("both", both).withColumn("total", F.size("_s_0") + F.size("_s_1") - F.col("both"))
    return out.where(F.col("both") >= shared if shared is not None else F.col("both") / F.col("total") >= jaccard).select(*block, a, b, "both", "total")


def _forms(rows: DataFrame, block: Sequence[str], text: str, key: str, items: str) -> DataFrame:
    """``rows`` with the alphanumeric key and the sorted distinct tokens of ``text``, each computed once a row."""
    return rows.withColumn(key, T.alnum_key(F.col(text))).withColumn(items, F.array_sort(T.tokens(F.col(text))))


def fuzzy_top1(rows: DataFrame, names: DataFrame, block: Sequence[str], ident: str, name: str, target: str, least: float = 0.30, tokens: bool = False) -> DataFrame:
    """For each row (``ident``) its best name of the same block from ``least`` on, the first by name on equal scores: ``ident, target, score``.

    The score of two keys (a-z and 0-9 of the lower-cased names) is 1 if equal; the shorter length over the longer, 0.65 at least, if
    one contains the other; else, with ``tokens``, the Jaccard similarity of the names' tokens. Names without
    a letter or digit match nothing. ``least`` must be positive.
    """
    ours = _forms(rows.select(*block, ident, name), block, name, "_ka", "_ta").where("_ka <> ''")
    theirs = _forms(names.select(*block, target), block, target, "_kb", "_tb").where("_kb <> ''")
    a = ours.select(*block, "_ka", "_ta").distinct()
    b = theirs.groupBy(*block, "_kb", "_tb").agg(F.min(target).alias(target))
    keys_a, keys_b = a.select(*block, "_ka").distinct(), b.select(*block, "_kb").distinct()
    equal = keys_a.join(keys_b.select(*block, F.col("_kb").alias("_ka"), "_kb"), [*block, "_ka"]).withColumn("score", F.lit(1.0))
    inside = contained(keys_a, keys_b, block, "_ka", "_kb").unionByName(contained(keys_b, keys_a, block, "_kb", "_ka")).where("_ka <> _kb")
    ratio = F.least(F.length("_ka"), F.length("_kb")) / F.greatest(F.length("_ka"), F.length("_kb"))
    inside = inside.withColumn("score", F.greatest(F.lit(0.65), ratio))
    scored = equal.select(*block, "_ka", "_kb", "score").unionByName(inside.select(*block, "_ka", "_kb", "score")).where(F.col("score") >= least)
    by_key = scored.join(b.groupBy(*block, "_kb").agg(F.min(target).alias(target)), [*block, "_kb"])
    best = _best(by_key, [*block, "_ka"], target).select(*block, "_ka", F.lit(None).cast("array<string>").alias("_ta"), "_b")
    if tokens:
        sets_a = a.withColumn("_ia", F.struct("_ka", "_ta"))
        sets_b = b.withColumn("_ib", F.struct("_kb", "_tb"))
        pairs = overlapping(sets_a, sets_b, block, "_ia", "_ib", "_ta", "_tb", jaccard=least)
        apart = ~F.contains(F.col("_ia._ka"), F.col("_ib._kb")) & ~F.contains(F.col("_ib._kb"), F.col("_ia._ka"))
        pairs = pairs.where(apart).withColumn("score", F.col("both") / F.col("total"))
        pairs = pairs.join(sets_b.select(*block, "_ib", target), [*block, "_ib"])
        more = _best(pairs, [*block, "_ia"], target).select(*block, F.col("_ia._ka").alias("_ka"), F.col("_ia._ta").alias("_ta"), "_b")
        # a form's best is that of its key or that of its tokens
        every = a.join(best.drop("_ta"), [*block, "_ka"]).select(*block, "_ka", "_ta", "_b").unionByName(more.select(*block, "_ka", "_ta", "_b"))
        best = every.groupBy(*block, "_ka", "_ta").agg(F.min("_b").alias("_b"))
        found = ours.join(best, [*block, "_ka", "_ta"])
    else:
        found = ours.join(best.drop("_ta"), [*block, "_ka"])
    return found.select(ident, F.col(f"_b.{target}").alias(target), (-F.col("_b._s")).alias("score"))


def _best(scored: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """For each key ``_b``: the highest score, negated, and the first target that has it."""
    return scored.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("_s"), F.col(target))).alias("_b"))


def token_overlap(rows: DataFrame, names: DataFrame, ident: str, name: str, target: str, least: int = 2, block: Sequence[str] = ()) -> DataFrame:
    """For each row the name of its block that shares most tokens, ``least`` or more, the first by name on equal counts: ``ident, target, shared``."""
    ours = rows.select(*block, ident, F.array_sort(T.tokens(F.col(name))).alias("_ta"))
    theirs = names.select(*block, target, F.array_sort(T.tokens(F.col(target))).alias("_tb")).groupBy(*block, "_tb").agg(F.min(target).alias(target))
    sets = ours.where(F.size("_ta") >= least).select(*block, "_ta").distinct()
    one = [*block] or ["_all"]
    if not block:
        sets, theirs = sets.withColumn("_all", F.lit(0)), theirs.withColumn("_all", F.lit(0))
    # a set of tokens is its own name
    pairs = overlapping(sets.withColumn("_ia", F.col("_ta")), theirs.withColumn("_ib", F.col("_tb")), one, "_ia", "_ib", "_ta", "_tb", shared=least)
    scored = pairs.join(theirs.select(*one, F.col("_tb").alias("_ib"), target), [*one, "_ib"]).withColumn("score", F.col("both").cast("long"))
    best = _best(scored, [*one, "_ia"], target).select(*block, F.col("_ia").alias("_ta"), "_b")
    return ours.join(best, [*block, "_ta"]).select(ident, F.col(f"_b.{target}").alias(target), (-F.col("_b._s")).alias("shared"))


#: What stands on either side of the words that say a material is derived from another.
_MODIFIED = r"(?i)^\s*([A-Za-z0-9\-+]+)\s+modified\s+with\s+([A-Za-z0-9\-+]+)\s*$"


def alias(rows: DataFrame, names: DataFrame, block: Sequence[str], ident: str, name: str, target: str, order: str) -> DataFrame:
    """For each row the name of its block that it is an alias of: ``ident, target, rule``; rows without one are left out.

    By the first rule that finds a name: ``key`` (the same sample key), ``modified`` ("X modified with Y": the key holds the
    keys of both X and Y), ``tokens`` (most tokens shared, two at least). Among several names the
    least by ``order`` counts for ``key`` and ``modified``, the first by name for ``tokens``.
    """
    keyed = rows.select(*block, ident, name).withColumn("_k", T.sample_key(F.col(name)))
    known = names.select(*block, target, order).withColumn("_h", T.sample_key(F.col(target))).where("_h <> ''")
    known = known.groupBy(*block, "_h").agg(F.min(F.struct(order, target)).alias("_n"))
    direct = keyed.join(known.select(*block, F.col("_h").alias("_k"), "_n"), [*block, "_k"]).select(ident, F.lit(1).alias("_r"), F.col(f"_n.{target}").alias(target))
    parts = keyed.select(*block, ident, *[T.sample_key(F.regexp_extract(name, _MODIFIED, i)).alias(f"_m{i}") for i in (1, 2)]).where("_m1 <> '' and _m2 <> ''")
    # the longer part leads to the names, the other is looked for in what is found
    lead = F.when(F.length("_m1") >= F.length("_m2"), F.col("_m1")).otherwise(F.col("_m2"))
    held = contained(parts.select(*block, "_m1", "_m2", lead.alias("_lead")).distinct(), known, block, "_lead", "_h").where("contains(_h, _m1) and contains(_h, _m2)")
    held = held.groupBy(*block, "_m1", "_m2").agg(F.min("_n").alias("_n"))
    modified = parts.join(held, [*block, "_m1", "_m2"]).select(ident, F.lit(2).alias("_r"), F.col(f"_n.{target}").alias(target))
    spelled = known.select(*block, F.col(f"_n.{target}").alias(target))
    shared = token_overlap(rows, spelled, ident, name, target, 2, block).select(ident, F.lit(3).alias("_r"), target)
    first = direct.unionByName(modified).unionByName(shared).groupBy(ident).agg(F.min(F.struct("_r", target)).alias("_b"))
    return first.select(ident, F.col(f"_b.{target}").alias(target), F.element_at(F.array(F.lit("key"), F.lit("modified"), F.lit("tokens")), F.col("_b._r")).alias("rule"))


def inferred_class(rows: DataFrame, known: DataFrame, block: Sequence[str], ident: str, name: str, cls: str, kept: Sequence[str], basic: str, least: float = 0.30) -> DataFrame:
    """The class of a row from the other samples of its block: ``ident, cls, rule``; rows that no rule reaches are left out.

    ``known`` has one row for each sample key and block, ``_k`` and its class. By the first rule that holds: ``key`` (the block
    knows it in a class of ``kept``), ``similar`` (the most similar key of such a class, from ``least`` on; the first by key on equal
    scores), ``suffix`` (another known key ends with it: the untreated material, class ``basic``), ``block`` (a row without a
    name in a block with one class of ``kept`` only).
    """
    keyed = rows.select(*block, ident, T.alnum_key(F.col(name)).alias("_k"))
    sound = known.where(F.col(cls).isin(list(kept))).select(*block, F.col("_k").alias("_known"), F.col(cls).alias("_c"))
    direct = keyed.join(sound.select(*block, F.col("_known").alias("_k"), "_c"), [*block, "_k"]).select(ident, F.lit(1).alias("_r"), "_c")
    near = fuzzy_top1(keyed, sound, block, ident, "_k", "_known", least)
    near = keyed.join(near, ident).join(sound, [*block, "_known"]).select(ident, F.lit(2).alias("_r"), "_c")
    ends = known.select(*block, "_k", F.explode(F.sequence(F.lit(2), F.length("_k"))).alias("_at")).where(F.length("_k") > 1).where("_at >= 2")
    ends = ends.select(*block, F.expr("substring(_k, _at)").alias("_k")).distinct()
    suffix = keyed.where("_k <> ''").join(ends, [*block, "_k"], "left_semi").select(ident, F.lit(3).alias("_r"), F.lit(basic).alias("_c"))
    single = sound.groupBy(*block).agg(F.min("_c").alias("_c"), F.max("_c").alias("_hi")).where("_c = _hi").drop("_hi")
    blank = keyed.where("_k = ''").join(single, list(block)).select(ident, F.lit(4).alias("_r"), "_c")
    first = direct.unionByName(near).unionByName(suffix).unionByName(blank).groupBy(ident).agg(F.min(F.struct("_r", "_c")).alias("_b"))
    rules = F.array(*[F.lit(r) for r in ("key", "similar", "suffix", "block")])
    return first.select(ident, F.col("_b._c").alias(cls), F.element_at(rules, F.col("_b._r")).alias("rule"))


def family_class(known: DataFrame, block: Sequence[str], cls: str, kept: Sequence[str], letter: str = "n") -> DataFrame:
    """``block, _k`` of the keys that descend from a key of a class in ``kept``: the block knows the key without its leading ``letter``, and that is such a key or descends from one.

    ``known`` has a row for each ``_k`` of a block.
    """
    ahead = F.length("_k") - F.length(F.ltrim(F.col("_k"), F.lit(letter)))
    deeper = known.select(*block, "_k", F.explode(F.sequence(F.lit(0), F.least(ahead, F.length("_k") - 1))).alias("_d")).where("_d > 0")
    bases = known.select(*block, F.col("_k").alias("_base"), F.col(cls).isin(list(kept)).alias("_good"))
    met = deeper.withColumn("_base", F.expr("substring(_k, _d + 1)")).join(bases, [*block, "_base"])
    # the nearest good base, and how many of the keys up to it the block knows
    good = met.groupBy(*block, "_k").agg(F.min(F.when(F.col("_good"), F.col("_d"))).alias("_to"), F.array_sort(F.collect_set("_d")).alias("_all"))
    return good.where("_to is not null and size(filter(_all, d -> d <= _to)) = _to").select(*block, "_k")
