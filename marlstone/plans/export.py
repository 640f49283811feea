"""From raw records to two clean tables: normalise, resolve ids, classify, fill, merge, collapse.

Every step is a DataFrame plan. Only greedy merging depends on the order of rows and
runs as one grouped pass for each paper. Blanks are null inside; ``ord`` is the source order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import match, records, resolve, similar
from marlstone.plans import vocabulary as V
from marlstone.plans.screening import classify_sample
from marlstone.sources.tables import ADSORPTION_FIELDS, MATERIAL_FIELDS
from marlstone.staging import stage_table

#: What a template row lends to its children.
_TEMPLATE = ["biomass_source", "pyrolysis_temp_C", "hold_duration_h", "heating_rate_C_min", "acid_type", "acid_conc_mol_L", "acid_conc_original", "acid_conc_mol_L_source", "acid_time_h", "acid_temp_C", "modification_sequence"]
_RANKS = ["unknown", "other", "pristine", "acid"]


def normalise_materials(raw: DataFrame) -> DataFrame:
    """``filename``, ``ord`` and the material fields of raw rows (``row`` a map); repeated scalars once, acid concentrations in mol/L with their source."""
    legacy = F.coalesce(F.col("row")["TPV_cm3_g"], F.col("row")["PV_cm3_g"])
    fields = [T.blank_to_null(T.dedupe_scalar(legacy if f == "TPV_cm3_g" else F.col("row")[f])).alias(f) for f in MATERIAL_FIELDS]
    out = raw.select(F.coalesce(F.col("row")["filename"], F.col("filename")).alias("filename"), "ord", *fields)
    out = out.withColumn("_c", T.acid_concentration(F.col("acid_conc_mol_L"), F.col("acid_type"))).withColumn("acid_conc_original", F.col("acid_conc_mol_L"))
    source = F.when(F.col("acid_conc_mol_L").isNull(), None).otherwise(F.coalesce(F.col("_c.source"), F.lit("reported_as_is")))
    return out.withColumn("acid_conc_mol_L_source", source).withColumn("acid_conc_mol_L", F.coalesce("_c.molar", "acid_conc_mol_L")).drop("_c")


def normalise_adsorption(raw: DataFrame) -> DataFrame:
    """``filename``, ``ord`` and the adsorption fields; temperatures in kelvin."""
    fields = [T.blank_to_null(T.to_kelvin(F.col("row")[f]) if f == "T_K" else F.col("row")[f]).alias(f) for f in ADSORPTION_FIELDS]
    return raw.select(F.coalesce(F.col("row")["filename"], F.col("filename")).alias("filename"), "ord", *fields)


def resolve_ids(rows: DataFrame) -> DataFrame:
    """One spelling of each sample id of a paper, one file name for an article and its supplements; ``paper`` is the key of both."""
    keyed = rows.withColumn("filename", T.plain_filename(F.col("filename"))).withColumn("paper", T.paper_key(F.col("filename"))).withColumn("_sid", T.sample_key(F.col("sample_id")))
    names = match.preferred(keyed, "paper", "filename", T.is_supplement(F.col("filename")), "ord").withColumnRenamed("filename", "_name")
    spelled = match.canonical(keyed.where("sample_id is not null and _sid <> ''"), ["paper", "_sid"], "sample_id")
    out = keyed.join(names, "paper", "left").join(spelled, ["paper", "_sid"], "left")
    return out.withColumn("filename", F.coalesce("_name", "filename")).withColumn("sample_id", F.coalesce("canonical", "sample_id")).drop("_name", "canonical", "_sid")


def alias_ids(adsorption: DataFrame, materials: DataFrame) -> DataFrame:
    """Adsorption rows under the spelling that their paper's materials have for the sample, aliases included (``similar.alias``)."""
    asked = adsorption.where("sample_id is not null").select("paper", "sample_id").distinct().withColumn("_i", F.struct("paper", "sample_id"))
    known = materials.where("sample_id is not null").groupBy("paper", F.col("sample_id").alias("_known")).agg(F.min("ord").alias("_ord"))
    found = similar.alias(asked, known, ["paper"], "_i", "sample_id", "_known", "_ord").select("_i.paper", "_i.sample_id", "_known")
    return adsorption.join(found, ["paper", "sample_id"], "left").withColumn("sample_id", F.coalesce("_known", "sample_id")).select(adsorption.columns)


def drop_false_samples(materials: DataFrame, adsorption: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Materials named like reagents, design runs or a pollutant of their paper go, and adsorption rows of reagents or of samples cited from other papers."""
    pollutants = adsorption.select("paper", T.alnum_key(F.col("pollutant_name")).alias("_s")).where("_s <> ''").distinct()
    sound = materials.where(~resolve.reagent(F.col("sample_id"), V.REAGENT_IDS) & ~resolve.design_run(F.col("sample_id"))).withColumn("_s", T.alnum_key(F.col("sample_id")))
    kept = adsorption.where(~resolve.reagent(F.col("sample_id"), V.REAGENT_IDS) & ~resolve.cited(F.col("sample_id")))
    return sound.join(pollutants, ["paper", "_s"], "left_anti").select(materials.columns), kept


def keep_targets(materials: DataFrame, adsorption: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose sample is acid-treated or pristine.

    A sample has the highest class of its rows in the paper; one of another class that descends from such a sample
    letter by letter counts as acid-treated. A material without an id has the class of its own fields. An adsorption row has the class of its sample in
    the paper, else in all papers, else that which the paper's other samples give it (``similar.inferred_class``), else that of its own id.
    """
    kept = ["acid", "pristine"]
    key = T.alnum_key(F.col("sample_id"))
    own = classify_sample(F.col("sample_id"), F.col("acid_type"), F.col("modification_sequence"))
    m = materials.withColumn("_k", key).withColumn("_own", own)
    best = records.lattice_max(m.where("_k <> ''"), ["paper", "_k"], "_own", _RANKS)
    family = similar.family_class(best, ["paper"], "_own", kept).withColumn("_born", F.lit(True))
    cls = F.when(~F.col("_own").isin(kept) & F.col("_born"), "acid").otherwise(F.col("_own"))
    known = stage_table(best.join(family, ["paper", "_k"], "left").select("paper", "_k", cls.alias("_class")), "classes")
    sound = known.where(F.col("_class").isin(kept)).select("paper", "_k")
    named = m.where("_k <> ''").join(sound, ["paper", "_k"], "left_semi")
    materials = named.unionByName(m.where((F.col("_k") == "") & F.col("_own").isin(kept))).select(materials.columns)
    # adsorption rows by distinct sample, so that every rule runs once for each
    samples = stage_table(adsorption.select("paper", "sample_id", key.alias("_k")).distinct().withColumn("_i", F.struct("paper", "sample_id")), "samples")
    everywhere = records.lattice_max(known, ["_k"], "_class", _RANKS).withColumnRenamed("_class", "_all")
    inferred = similar.inferred_class(samples, known, ["paper"], "_i", "sample_id", "_class", kept, "pristine").select("_i", F.col("_class").alias("_inferred"))
    blank = F.lit(None).cast("string")
    fallen = F.coalesce("_inferred", classify_sample(F.col("sample_id"), blank, blank))
    judged = samples.join(known, ["paper", "_k"], "left").join(everywhere.where("_k <> ''"), "_k", "left").join(inferred, "_i", "left")
    judged = judged.where(F.coalesce("_class", "_all", fallen).isin(kept)).select("paper", F.col("sample_id").alias("_s"))
    stay = adsorption.join(judged.withColumnRenamed("paper", "_p"), F.col("paper").eqNullSafe(F.col("_p")) & F.col("sample_id").eqNullSafe(F.col("_s")), "left_semi")
    return materials, stay


def merge_adsorption(rows: DataFrame) -> DataFrame:
    """Complementary adsorption rows of a paper become one: equal samples and pollutants where known, no contradiction, and an equal condition where a sample is blank."""
    pollutant_last = [*resolve.CONDITIONS, "Qmax", "pollutant_name"]
    merged = records.greedy_merge(rows.select("paper", "sample_id", *pollutant_last, "ord"), "paper", ["sample_id"], pollutant_last, "ord", 1, resolve.CONDITIONS).drop("merged_rows")
    return _named(merged, rows)


def _named(merged: DataFrame, rows: DataFrame) -> DataFrame:
    """Merged rows with the file name of their paper."""
    names = match.preferred(rows, "paper", "filename", T.is_supplement(F.col("filename")), "ord")
    return merged.join(names, "paper", "left").select(*[c for c in rows.columns if c in merged.columns or c == "filename"])


def export_tables(raw_materials: DataFrame, raw_adsorption: DataFrame, targets_only: bool = True, placeholders: bool = False) -> tuple[DataFrame, DataFrame]:
    """Materials (one row a sample) and adsorption (one row a sample, pollutant and condition; rows without a sample as they are) from raw rows ``filename, ord, row``.

    In order: normalise; one spelling of ids; false samples out; templates to their children; targets;
    ids filled in; shared fields; unresolved rows absorbed; rows merged; conditions shared; one row a
    sample; guards; with ``placeholders`` names for what is still without an id, whose rows then are absorbed or go.
    """
    def both(m: DataFrame, a: DataFrame, step: str) -> tuple[DataFrame, DataFrame]:
        # a step uses its input several times: without a cut the plan would double with each
        return stage_table(m, f"{step}-materials"), stage_table(a, f"{step}-adsorption")

    values = [f for f in MATERIAL_FIELDS if f != "sample_id"]
    m, a = both(resolve_ids(normalise_materials(raw_materials)), resolve_ids(normalise_adsorption(raw_adsorption)), "named")
    m, a = drop_false_samples(m, alias_ids(a, m))
    m, a = both(resolve.propagate_templates(m, _TEMPLATE), a, "sound")
    if targets_only:
        m, a = both(*keep_targets(m, a), "targets")
    together = stage_table(resolve.autofilled(m, a), "filled")
    m, a = resolve.parted(together, m.columns, a.columns)
    m = resolve.absorb(stage_table(resolve.fill_shared_materials(m), "shared"), resolve.MATERIAL_MATCH, values, resolve.SHARED)
    a = resolve.absorb(a, resolve.ADSORPTION_KEY, [*resolve.ADSORPTION_KEY, "Qmax"])
    m, a = both(m, a, "absorbed")
    merged = records.greedy_merge(m.select("paper", "sample_id", *values, "ord"), "paper", ["sample_id"], values, "ord", 2, resolve.MATERIAL_KEY).drop("merged_rows")
    m, a = both(_named(merged, m), merge_adsorption(a), "merged")
    a = resolve.fill_shared_adsorption(a)
    named, nameless = m.where("sample_id is not null"), m.where("sample_id is null")
    m = _named(records.collapse(named, ["paper", "sample_id"], values, "ord").drop("merged_rows"), m).select(m.columns).unionByName(nameless)
    m, a = both(m, a, "collapsed")
    m = resolve.clear_base_acid(m)
    if placeholders:
        m = records.placeholder_ids(m, "paper", resolve.MATERIAL_KEY, "sample_id", "ord", resolve.UNRESOLVED.rstrip("_"))
        a = records.placeholder_ids(a, "paper", resolve.ADSORPTION_KEY, "sample_id", "ord", resolve.UNRESOLVED.rstrip("_"))
        m = resolve.absorb(m, resolve.MATERIAL_MATCH, values, resolve.SHARED)
        a = stage_table(resolve.absorb(a, resolve.ADSORPTION_KEY, [*resolve.ADSORPTION_KEY, "Qmax"]), "placed")
    a = resolve.collapse_adsorption(a)
    m = m.withColumn("pyrolysis_temp_C", resolve.single_temperature(F.col("sample_id"), F.col("pyrolysis_temp_C")))
    return m.select("filename", "sample_id", *values), a.select("filename", *ADSORPTION_FIELDS)
