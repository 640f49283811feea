"""Screening of documents: weighted keywords, sentence contexts, and an ordered list of rules for the verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.automaton import Words
from marlstone.plans import vocabulary as V

#: Signals that count keywords of one list in the whole text.
KEYWORD_SIGNALS = {
    "topic": V.TOPIC, "acid_reagent": V.ACID_REAGENTS, "acid_mod": V.ACID_MODIFIED, "biochar_prep": V.BIOCHAR_PREPARATION, "method": V.METHOD, "data": V.DATA,
    "heavy_metal": V.HEAVY_METAL, "non_heavy_pollutant": V.OTHER_POLLUTANT, "composite": V.COMPOSITE, "review": V.REVIEW,
    "characterization": V.CHARACTERIZATION, "ads_condition": V.ADSORPTION_CONDITION, "ads_performance": V.ADSORPTION_PERFORMANCE,
}
KEYWORDS = Words(KEYWORD_SIGNALS)
PROFILES = ("legacy", "acid-biochar-strict", "acid-biochar-radionuclide", "acid-biochar-radionuclide-loose")
_STRICT, _NUCLIDE, _LOOSE = "profile <> 'legacy'", "profile like 'acid-biochar-radionuclide%'", "profile = 'acid-biochar-radionuclide-loose'"

#: The verdict is that of the first rule that holds (condition, status, reason).
RULES = [
    ("scanned_suspect", "FAIL", "Likely scanned PDF or low selectable text; OCR needed first."),
    (f"{_STRICT} and n_review > 0 and n_method <= 2", "FAIL", "Review/conceptual article likely; lacks primary experimental focus."),
    (f"{_STRICT} and (n_topic = 0 or n_biochar_prep = 0)", "FAIL", "No clear biochar preparation context."),
    (f"{_NUCLIDE} and n_biochar_word = 0", "FAIL", "No explicit biochar evidence."),
    (f"{_NUCLIDE} and n_radionuclide = 0", "FAIL", "No clear radionuclide/analog pollutant evidence (U(VI), Cs(I), Sr(II), Co(II), I-/IO3-, TcO4-, Th(IV), Eu(III), La(III), Ce(III), ReO4-)."),
    (f"{_LOOSE} and n_acid_reagent = 0 and n_acid_mod > 0", "MAYBE", "Acid-modified biochar wording found, but no explicit acid reagent was extracted."),
    (f"{_STRICT} and n_acid_reagent = 0", "FAIL", "No acid reagent evidence."),
    (f"{_STRICT} and n_heavy_metal = 0", "FAIL", "No clear heavy-metal pollutant evidence."),
    (f"{_LOOSE} and acid_prep_sentences = 0 and (n_acid_mod > 0 or n_acid_context > 0)", "MAYBE", "Has acid-modified biochar + radionuclide signals, but acid-preparation sentence was not extracted."),
    (f"{_STRICT} and acid_prep_sentences = 0", "FAIL", "No acid-treatment sentence linking reagent with biochar/preparation context."),
    (f"{_LOOSE} and recipe_windows = 0", "MAYBE", "Has acid-biochar + radionuclide signals, but acid-treatment recipe evidence is incomplete."),
    (f"{_STRICT} and recipe_windows = 0", "FAIL", "No acid-treatment recipe evidence (prep context + concentration/time/temperature)."),
    (f"{_LOOSE} and acid_conditions = 0", "MAYBE", "Has acid-biochar + radionuclide signals, but explicit acid-treatment conditions were not extracted."),
    (f"{_STRICT} and acid_conditions = 0", "FAIL", "No explicit acid-treatment condition (concentration/time/temperature)."),
    (f"{_STRICT} and ph_sentences > 0 and acid_prep_sentences <= 1 and n_acid_context = 0", "FAIL", "Acid usage appears to be only pH adjustment, not acid modification."),
    (f"{_STRICT} and n_characterization = 0", "FAIL", "Missing key adsorbent characterization signals (BET/pore/elemental)."),
    (f"{_STRICT} and n_ads_condition = 0", "FAIL", "Missing adsorption experimental condition signals."),
    (f"{_STRICT} and n_ads_performance = 0", "FAIL", "Missing adsorption performance/model signals (Qe/Qm/isotherm/kinetics)."),
    ("profile = 'acid-biochar-radionuclide' and n_method >= 1 and (data_score >= 3 or unit_hits >= 6)", "PASS", "Matched strict acid-biochar + radionuclide criteria for structured extraction."),
    (f"{_LOOSE} and n_method >= 1 and (data_score >= 3 or unit_hits >= 6)", "PASS", "Matched loose acid-biochar + radionuclide criteria for manual/structured extraction."),
    (f"{_STRICT} and n_method >= 1 and (data_score >= 3 or unit_hits >= 6)", "PASS", "Matched strict acid-biochar criteria for structured extraction."),
    (f"{_NUCLIDE} and (data_score >= 2 or unit_hits >= 4)", "MAYBE", "Has acid-biochar + radionuclide signals but structured data evidence is limited."),
    (f"{_STRICT} and (data_score >= 2 or unit_hits >= 4)", "MAYBE", "Has acid-biochar signals but structured data evidence is limited."),
    (f"{_NUCLIDE}", "FAIL", "Insufficient structured signals for strict acid-biochar + radionuclide extraction."),
    (f"{_STRICT}", "FAIL", "Insufficient structured signals for strict acid-biochar extraction."),
    ("n_topic >= 3 and n_method >= 1 and (data_score >= 4 or unit_hits >= 8)", "PASS", "Strong topic/method/data signals for structured extraction."),
    ("n_topic >= 2 and (data_score >= 2 or unit_hits >= 4)", "MAYBE", "Partially matched; inspect manually before full extraction."),
    ("true", "FAIL", "Weak topic or insufficient extractable structured signals."),
]


def first_rule(rules: list[tuple[str, str, str]]) -> Column:
    """Struct ``status, reason`` of the first rule whose condition holds."""
    out = None
    for condition, status, reason in rules:
        value = F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
        out = F.when(F.expr(condition), value) if out is None else out.when(F.expr(condition), value)
    return out


def _said(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?i){pattern}")


#: What some radionuclide pattern needs in a text, whatever else it needs.
_ANY_NUCLIDE = (
    r"uranium|c(?:a)?esium|strontium|cobalt|iod(?:ide|ate)|technet|thorium|europium|lanthanum|cerium|rhen|"
    r"(?:u|cs|sr|co|th|eu|la|ce)\s*\(|io\s*[3₃]|tc\s*o\s*[4₄]|re\s*o\s*[4₄]|i\s*[-−–—⁻]"
)


def sentence_flags(c: Column, text: Column) -> Column:
    """For each sentence of ``c``: acid preparation, acid condition, pH adjustment, radionuclide context.

    Costly patterns are tried only where the whole (lower-case) ``text`` has what they need.
    """
    acids = F.lit(False)
    for word in V.ACID_REAGENTS:
        acids = acids | text.contains(word)
    adjusted = text.contains("ph") & (text.contains("adjust") | text.contains("using")) | text.contains("naoh") | text.contains("hcl")
    nuclides = text.rlike(_ANY_NUCLIDE)

    def flags(has: Column, s: Column) -> Column:
        ph = has["adjusted"] & _said(s, V.PH_ADJUSTMENT)
        acid = has["acids"] & _said(s, V.REAGENT) & ~ph & ~_said(s, V.NO_MODIFICATION)

        def whole(said: Column) -> Column:
            prepared = said["acid"] & (_said(s, V.BIOCHAR) | _said(s, V.PREPARATION_VERB)) & _said(s, V.PREPARATION_CUE)
            stated = said["acid"] & (_said(s, V.CONCENTRATION) | _said(s, V.DURATION) | _said(s, V.TEMPERATURE))
            return F.struct(prepared.alias("prep"), stated.alias("cond"), said["ph"].alias("ph"), (has["nuclides"] & _said(s, V.RADIONUCLIDE_CONTEXT)).alias("ctx"), s.alias("s"))

        return F.get(F.transform(F.array(F.struct(ph.alias("ph"), acid.alias("acid"))), whole), F.lit(0))

    def of_text(has: Column) -> Column:
        return F.when(has["acids"] | has["adjusted"] | has["nuclides"], F.transform(c, lambda s: flags(has, s))).otherwise(F.array().cast("array<struct<prep: boolean, cond: boolean, ph: boolean, ctx: boolean, s: string>>"))

    # bound first: written out, the whole text would be searched again for every sentence
    return F.get(F.transform(F.array(F.struct(acids.alias("acids"), adjusted.alias("adjusted"), nuclides.alias("nuclides"))), of_text), F.lit(0))


def adjacent_pairs(flags: Column, first: str = "prep", second: str = "cond") -> Column:
    """Sentences where both flags hold, or one here and the other in the next sentence."""
    following = F.transform(F.sequence(F.lit(1), F.size(flags)), lambda i: F.get(flags, i))
    paired = F.zip_with(flags, following, lambda a, b: (a[first] & a[second]) | (F.coalesce(b[second], F.lit(False)) & a[first]) | (F.coalesce(b[first], F.lit(False)) & a[second]))
    return F.when(F.size(flags) == 0, F.lit(0)).otherwise(F.size(F.filter(paired, lambda x: x)))


def signals(docs: DataFrame, text_col: str = "text", pages_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` but the text, with hit lists, signals and scores: what the rules of every profile look at.

    One projection for each step keeps every regular expression evaluated once. A null
    text is an empty one and fails as scanned.
    """
    out = docs.withColumn("_raw", T.strip_tail(F.coalesce(F.col(text_col), F.lit("")))).withColumn("_norm", T.fold(F.col("_raw")))
    out = out.withColumn("_flags", sentence_flags(T.sentences(F.col("_raw")), F.col("_norm")))
    # every list in one reading of the text
    out = out.withColumn("_words", KEYWORDS.found(F.col("_norm")))
    out = out.withColumns({f"matched_{name}": KEYWORDS.hits(F.col("_words"), name) for name in KEYWORD_SIGNALS})
    out = out.withColumn("matched_acid_context", F.when(F.col("_norm").contains("acid") | (F.size("matched_acid_reagent") > 0), T.pattern_hits(F.col("_norm"), V.ACID_CONTEXT)).otherwise(F.array().cast("array<string>")))
    nuclides = F.array_distinct(F.flatten(F.transform(F.filter("_flags", lambda f: f.ctx), lambda f: T.pattern_hits(f.s, V.RADIONUCLIDE))))
    out = out.withColumn("matched_radionuclide", nuclides)
    counts = {f"n_{n}": F.size(f"matched_{n}") for n in [*KEYWORD_SIGNALS, "acid_context", "radionuclide"]}
    pages = F.greatest(F.coalesce(F.col(pages_col), F.lit(0)), F.lit(1)) if pages_col else F.lit(1)
    out = out.withColumns(counts).withColumns({
        "acid_prep_sentences": F.size(F.filter("_flags", lambda f: f.prep)), "acid_conditions": F.size(F.filter("_flags", lambda f: f.cond)),
        "acid_recipe_sentences": F.size(F.filter("_flags", lambda f: f.prep & f.cond)), "ph_sentences": F.size(F.filter("_flags", lambda f: f.ph)),
        "recipe_windows": adjacent_pairs(F.col("_flags")), "n_biochar_word": _said(F.col("_norm"), V.BIOCHAR).cast("int"),
        "unit_hits": F.regexp_count("_norm", F.lit(f"(?i){V.UNIT}")), "table_hits": F.regexp_count("_norm", F.lit(f"(?i){V.TABLE}")),
        "text_chars": F.length("_norm"), "chars_per_page": F.length("_norm") / pages,
    })
    out = out.withColumns({"data_score": F.col("n_data") + F.least("table_hits", F.lit(5)), "scanned_suspect": (F.col("text_chars") < 3000) | (F.col("chars_per_page") < 200)})
    return out.withColumn("score_total", F.col("n_topic") * 4 + F.col("n_method") * 2 + F.col("data_score")).drop("_raw", "_norm", "_flags", "_words", text_col)


def verdicts(found: DataFrame, profiles: Sequence[str] = PROFILES) -> DataFrame:
    """``profile, status, reason`` beside the signals of a document, a row for each profile: texts are looked at once whatever the profiles."""
    # one profile as a literal: signals that its rules do not look at are then not computed
    asked = found.withColumn("profile", F.lit(profiles[0]) if len(profiles) == 1 else F.explode(F.array(*[F.lit(p) for p in profiles])))
    return asked.withColumn("_verdict", first_rule(RULES)).select("*", "_verdict.*").drop("_verdict")


def screen(docs: DataFrame, profile: str = "legacy", text_col: str = "text", pages_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` but the text, with hit lists, signals, scores, ``status`` and ``reason`` under one profile."""
    return verdicts(signals(docs, text_col, pages_col), [profile])




def classify_sample(sample_id: Column, acid_type: Column, sequence: Column) -> Column:
    """acid, pristine, other or unknown, by rules in order (nulls count as blank)."""
    whole = T.fold(F.concat_ws(" ", sample_id, acid_type, sequence))
    sid, folded, acid = T.alnum_key(sample_id), T.fold(sample_id), T.fold(acid_type)

    def any_of(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | whole.contains(w)
        return out

    non_acid = any_of(V.NON_ACID_WORDS)
    cited = folded.contains("et al") & folded.rlike(r"\b(?:19|20)[0-9]{2}\b")
    parameter = sid.isin(V.PARAMETER_IDS) | folded.isin(V.PARAMETER_NAMES)
    return (
        F.when(whole == "", "unknown")
        .when(cited | parameter | sid.isin(V.DROPPED_IDS), "other")
        .when(any_of(V.EXCLUDED_WORDS), "other")
        .when(any_of(V.ACID_WORDS) | ((acid != "") & ~non_acid), "acid")
        .when(any_of(V.SOFT_AFTER_WORDS) & ~non_acid, "unknown")
        .when(non_acid, "other")
        .when(any_of(V.PRISTINE_WORDS) | sid.isin(V.PRISTINE_IDS), "pristine")
        .when(any_of(V.CHANGED_WORDS), "other")
        .otherwise("unknown")
    )
