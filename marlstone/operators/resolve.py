"""Samples without a usable id: conservative filling, absorption into known rows, guards.

Steps in which a filled row is evidence for the next run as one ordered pass for each
file or paper, over rows sorted by the engine; what is order-free is a plan.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marlstone.functions import text as T
from marlstone.operators import fill, match, records

UNRESOLVED = "UNRESOLVED_"
#: Fields that tell materials and measurements apart, and those a paper may share.
MATERIAL_KEY = ["biomass_source", "pyrolysis_temp_C", "acid_type", "acid_conc_mol_L", "acid_time_h", "acid_temp_C", "modification_sequence"]
CONDITIONS = ["pH", "T_K", "Te_min", "SLR_g_L"]
ADSORPTION_KEY = ["pollutant_name", *CONDITIONS]
MATERIAL_MATCH = ["biomass_source", "pyrolysis_temp_C", "hold_duration_h", "acid_type", "acid_conc_mol_L", "acid_time_h", "acid_temp_C", "modification_sequence"]
SHARED = ["biomass_source", "pyrolysis_temp_C", "hold_duration_h", "heating_rate_C_min"]
ACID = ["acid_type", "acid_conc_mol_L", "acid_time_h", "acid_temp_C"]
BASES = ["BC", "PBC", "MB", "SC", "DC", "HC"]


def norm(value: object) -> str:
    """Lower-case text with single blanks; nothing for null."""
    return " ".join(str(value).lower().split()) if value is not None else ""


def ordered_pass(df: DataFrame, key: str, order: Sequence[str], work: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """``work`` on the rows of each key, in order; it returns rows of the same columns. Keys are dealt by hash; a key's rows are held by one task, as the steps ask."""
    schema = df.schema
    target = to_arrow_schema(StructType(list(schema.fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        for batch in batches:
            done: list[dict] = []
            for row in batch.to_pylist():
                if own and own[0][key] != row[key]:
                    done += work(own)
                    own = []
                own.append(row)
            yield pa.RecordBatch.from_pylist(done, schema=target)
        yield pa.RecordBatch.from_pylist(work(own) if own else [], schema=target)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


class Evidence:
    """Rows with an id: found again by a whole key or by votes of equal fields, which are counted by id as rows come."""

    def __init__(self, fields: Sequence[str], least: int = 2) -> None:
        self.fields, self.least = fields, least
        self.exact: dict[tuple, set[str]] = defaultdict(set)
        self.having: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.met: set[tuple] = set()

    def key(self, row: dict) -> tuple:
        return tuple(norm(row[f]) for f in self.fields)

    def said(self, key: tuple) -> list[tuple[str, str]]:
        return [(f, v) for f, v in zip(self.fields, key, strict=True) if v]

    def add(self, row: dict) -> None:
        key = self.key(row)
        self.exact[key].add(row["sample_id"])
        said = self.said(key)
        for value in said:
            self.having[value][row["sample_id"]] += 1
        self.met.update(combinations(said, self.least))

    def by_key(self, row: dict) -> str | None:
        found = self.exact.get(self.key(row), set()) if any(self.key(row)) else set()
        return next(iter(found)) if len(found) == 1 else None

    def by_vote(self, row: dict) -> str | None:
        """The strict winner, where some row has ``least`` fields in common."""
        said = self.said(self.key(row))
        if not any(c in self.met for c in combinations(said, self.least)):
            return None
        votes: Counter = Counter()
        for value in said:
            votes.update(self.having.get(value, {}))
        top = votes.most_common(2)
        return top[0][0] if len(top) == 1 or top[0][1] > top[1][1] else None


def _autofill(rows: list[dict]) -> list[dict]:
    every = {r["sample_id"] for r in rows if norm(r["sample_id"])}
    known = {0: Evidence(MATERIAL_KEY), 1: Evidence(ADSORPTION_KEY)}
    for row in rows:
        if norm(row["sample_id"]):
            known[row["_table"]].add(row)
    for row in rows:
        if norm(row["sample_id"]):
            continue
        evidence = known[row["_table"]]
        found = next(iter(every)) if len(every) == 1 else evidence.by_key(row)
        if found is None and row["_table"] == 1:
            found = evidence.by_vote(row)
        if found is not None:
            row["sample_id"] = found
            evidence.add(row)
    return rows


def _together(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("_table", F.lit(0)).unionByName(b.withColumn("_table", F.lit(1)), allowMissingColumns=True)


def autofill_ids(materials: DataFrame, adsorption: DataFrame, block: str = "paper") -> tuple[DataFrame, DataFrame]:
    """Blank ``sample_id`` of either table from the same file: its only id, else the one id of equal key fields, else (adsorption) the strict winner of a vote with two equal fields or more.

    A filled row is evidence for the rows after it; materials come before adsorption, each in the order of ``ord``.
    """
    return parted(autofilled(materials, adsorption, block), materials.columns, adsorption.columns)


def autofilled(materials: DataFrame, adsorption: DataFrame, block: str = "paper") -> DataFrame:
    """Both tables as one (``_table`` 0 and 1) after ``autofill_ids``."""
    return ordered_pass(_together(materials, adsorption), block, ["_table", "ord"], _autofill)


def parted(together: DataFrame, materials: Sequence[str], adsorption: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return together.where("_table = 0").select(*materials), together.where("_table = 1").select(*adsorption)


def unresolved(c: Column) -> Column:
    return F.coalesce(F.upper(T.strip(c)).startswith(UNRESOLVED), F.lit(False))


def _absorb(fields: Sequence[str], columns: Sequence[str], shared: Sequence[str]) -> Callable[[list[dict]], list[dict]]:
    def work(rows: list[dict]) -> list[dict]:
        loose = [r for r in rows if norm(r["sample_id"]).upper().startswith(UNRESOLVED)]
        sound = [r for r in rows if not norm(r["sample_id"]).upper().startswith(UNRESOLVED)]
        left = []
        for row in loose:
            scores = [sum(1 for f in fields if norm(row[f]) and norm(row[f]) == norm(s[f])) for s in sound]
            top = max(scores, default=0)
            filled = 0
            if top >= 2 and scores.count(top) == 1:
                target = sound[scores.index(top)]
                for c in columns:
                    if not norm(target[c]) and norm(row[c]):
                        target[c] = row[c]
                        filled += 1
            if not filled:
                left.append(row)
        for c in shared:
            values = {str(r[c]).strip() for r in left if norm(r[c])}
            if len(values) == 1:
                for s in sound:
                    if not norm(s[c]):
                        s[c] = next(iter(values))
        return sound

    return work


def absorb(rows: DataFrame, fields: Sequence[str], columns: Sequence[str], shared: Sequence[str] = (), block: str = "paper") -> DataFrame:
    """Rows of unresolved ids lend their values to the one row of the block that agrees in most ``fields`` (two or more), which may change what the next one finds; then they go.

    What is unique among those that found no row fills ``shared`` fields of the block.
    """
    # blocks without an unresolved id stay as they are
    loose = rows.where(F.contains(F.upper("sample_id"), F.lit(UNRESOLVED))).select(F.col(block).alias("_b")).distinct()
    is_loose = F.col(block).eqNullSafe(F.col("_b"))
    passed = ordered_pass(rows.join(loose, is_loose, "left_semi"), block, ["ord"], _absorb(fields, columns, shared))
    return rows.join(loose, is_loose, "left_anti").unionByName(passed)


def fill_shared_materials(rows: DataFrame) -> DataFrame:
    """Acid fields shared by a paper's rows of one acid; what a paper says once, for its base samples; heat treatment of the base, for the other samples of its family."""
    fields = [c for c in ACID if c != "acid_type"]
    keyed = rows.withColumn("_acid", T.fold(F.col("acid_type")))
    out = fill.fill_unique(keyed.where("_acid <> ''"), ["paper", "_acid"], fields).unionByName(keyed.where("_acid = ''")).drop("_acid")
    family = T.sample_family(F.col("sample_id"))
    out = out.withColumn("_family", F.when(family.isin(BASES), family)).withColumn("_base", F.coalesce(T.is_base_of(F.col("sample_id"), F.col("_family")), F.lit(False)))
    said = rows.groupBy("paper").agg(*[fill.unique_value(F.col(c)).alias(f"_p_{c}") for c in SHARED])
    out = out.join(said, "paper", "left").withColumns({c: F.coalesce(c, F.when(F.col("_base"), F.col(f"_p_{c}"))) for c in SHARED}).drop(*[f"_p_{c}" for c in SHARED])
    heat = [c for c in SHARED if c != "biomass_source"]
    bases = out.where("_base").groupBy("paper", "_family").agg(*[fill.unique_value(F.col(c)).alias(f"_f_{c}") for c in heat])
    out = out.join(bases, ["paper", "_family"], "left").withColumns({c: F.coalesce(c, F.when(~F.col("_base"), F.col(f"_f_{c}"))) for c in heat})
    return out.select(rows.columns)


def clear_base_acid(rows: DataFrame) -> DataFrame:
    """Acid fields of a base sample go where its family has another sample, unless its own sequence speaks of acid."""
    family = T.sample_family(F.col("sample_id"))
    keyed = rows.withColumn("_family", F.when(family.isin(BASES), family)).withColumn("_base", F.coalesce(T.is_base_of(F.col("sample_id"), F.col("_family")), F.lit(False)))
    has = keyed.where("_family is not null").groupBy("paper", "_family").agg(F.max(~F.col("_base")).alias("_has"))
    own = F.coalesce(F.lower("modification_sequence").contains("acid"), F.lit(False))
    guard = F.col("_base") & F.coalesce("_has", F.lit(False)) & ~own
    return keyed.join(has, ["paper", "_family"], "left").withColumns({c: F.when(~guard, F.col(c)) for c in ACID}).select(rows.columns)


def fill_shared_adsorption(rows: DataFrame) -> DataFrame:
    """Conditions that are unique for a paper's sample and pollutant, then for its sample, fill blanks; temperatures in kelvin; rows without a sample stay as they are."""
    keyed = rows.withColumn("T_K", T.to_kelvin(F.col("T_K"))).withColumn("_s", T.fold(F.col("sample_id"))).withColumn("_p", T.fold(F.col("pollutant_name")))
    named = fill.fill_unique(fill.fill_unique(keyed.where("_s <> ''"), ["paper", "_s", "_p"], CONDITIONS), ["paper", "_s"], CONDITIONS)
    return named.unionByName(keyed.where("_s = ''")).select(rows.columns)


def adsorption_key(c: Column) -> Column:
    """A sample id for grouping: without words for sample and material, blanks and marks but the hyphen."""
    bare = F.regexp_replace(T.fold(c), r"\b(?:sample|adsorbent|biochar|biosorbent)\b", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[\s_]+", ""), r"[^a-z0-9-]+", "")


def collapse_adsorption(rows: DataFrame) -> DataFrame:
    """One row for each sample, pollutant and set of conditions of a paper, the fullest filled from the others; of several spellings the plainest id and the commonest pollutant name. Rows without a sample stay as they are."""
    fields = ["sample_id", *ADSORPTION_KEY, "Qmax"]
    named, nameless = rows.where(~T.is_blank(F.col("sample_id"))), rows.where(T.is_blank(F.col("sample_id")))
    group = adsorption_key(F.col("sample_id"))
    keys = {"_k_sid": F.when(group != "", group).otherwise(T.fold(F.col("sample_id"))), **{f"_k_{c}": T.fold(F.col(c)) for c in ADSORPTION_KEY}}
    keyed = named.withColumns(keys)
    by = ["paper", *keys]
    whole = records.collapse(keyed, by, fields, "ord")
    plain = F.struct((group != F.replace(T.fold(F.col("sample_id")), F.lit(" "), F.lit(""))).alias("a"), F.length("sample_id").alias("b"), F.lower("sample_id").alias("c"), F.col("sample_id").alias("d"))
    names = keyed.groupBy(*by).agg(F.min_by("sample_id", plain).alias("_sid"), F.min_by("filename", F.struct(T.is_supplement(F.col("filename")).alias("a"), F.col("ord").alias("b"))).alias("filename"), F.min_by("pollutant_name", F.when(F.col("pollutant_name").isNotNull(), F.col("ord"))).alias("_pollutant"))
    out = whole.join(names, by).withColumns({"sample_id": F.coalesce("_sid", "sample_id"), "pollutant_name": F.coalesce("_pollutant", "pollutant_name")})
    return out.select(rows.columns).unionByName(nameless)


#: A sample id that ends in its one temperature, and what parts several values in a cell.
_POINT = r"^SCRH-[A-Z]-[0-9]+(?:\.[0-9]+)?-([0-9]{2,4})$"
_SEVERAL = r",|;|/| to | and |~|—|–"


def single_temperature(sample_id: Column, temperature: Column) -> Column:
    """The temperature that a condition point's id ends in, where the cell is blank or holds several numbers; else the cell."""
    own = F.regexp_extract(F.upper(T.strip(F.coalesce(sample_id, F.lit("")))), _POINT, 1)
    numbers = F.size(F.regexp_extract_all(F.coalesce(temperature, F.lit("")), F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0)))
    several = (numbers > 1) & temperature.rlike(_SEVERAL)
    return F.when((own != "") & (T.is_blank(temperature) | F.coalesce(several, F.lit(False))), own).otherwise(temperature)


def propagate_templates(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows such as ``SCRH-S-m-T`` lend their fields to the paper's rows ``SCRH-S-...`` that hold a number, and go where there is one."""
    sid = T.sample_key(F.col("sample_id"))
    prefix = F.coalesce(F.nullif(F.regexp_extract(sid, "^([A-Z0-9]+-[A-Z])-M-T$", 1), F.lit("")), F.nullif(F.regexp_extract(sid, "^([A-Z0-9]+-[A-Z])-.*[0-9]", 1), F.lit("")))
    return match.inherit_from_template(rows, sid.rlike("^[A-Z0-9]+-[A-Z]-M-T$"), prefix, columns, ["paper"])


def design_run(c: Column) -> Column:
    """A letter and up to three digits: a run of an experimental design."""
    return F.coalesce(F.upper(T.strip(c)).rlike(r"^[A-Z][0-9]{1,3}$"), F.lit(False))


def cited(c: Column) -> Column:
    """A sample of another paper: a citation number in brackets, or ``et al`` and a year."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return low.rlike(r"\[[0-9]{1,3}(?:\s*,\s*[0-9]{1,3})*\]") | (low.contains("et al") & low.rlike(r"\b(19|20)[0-9]{2}\b"))


def reagent(c: Column, words: Sequence[str]) -> Column:
    """An id that names a reagent and looks like no sample: no code, no base material, no char."""
    low = F.lower(F.coalesce(c, F.lit("")))
    sample = F.upper(low).rlike(r"[A-Z]{1,6}[0-9]{1,4}|\b(?:BC|PBC|MB|HC|SC|DC|NHC|NSC|NDC|SCRH|RSB|SDB)\b") | low.contains("char")
    return ~sample & (F.size(T.keyword_hits(low, list(words))) > 0)


def class_of(rows: DataFrame, classes: DataFrame, block: Sequence[str], ident: str, column: str, ranks: Sequence[str], infer: Column) -> DataFrame:
    """``rows`` with ``column``: the highest class of their id in the block, else of the id anywhere, else as inferred from the row itself."""
    near = records.lattice_max(classes, [*block, ident], column, ranks).withColumnRenamed(column, "_near")
    far = records.lattice_max(classes, [ident], column, ranks).withColumnRenamed(column, "_far")
    out = rows.join(near, [*block, ident], "left").join(far, ident, "left")
    return out.withColumn(column, F.coalesce("_near", "_far", infer)).select(*rows.columns, column)
