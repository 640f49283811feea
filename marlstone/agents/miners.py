"""Mining articles with a model: classes of paragraphs, then records of synthesis, properties and tables.

Each step is a table of prompts answered through ``seam.ask``; what a reply means is read by plain rules,
so that kept replies give the same records again. Prompts are short and of our own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.agents import replies, seam
from marlstone.functions import text as T
from marlstone.staging import stage_table

#: Words that say what a text is about where a model names nothing.
PREPARATION_WORDS = ["biochar", "pyrolysis", "acid", "hcl", "hno3", "h2so4", "h3po4"]
EXPERIMENT_WORDS = ["adsorption", "qe", "c0", "cd", "pb", "cr(vi)", "ni(ii)", "co(ii)", "cu(ii)"]
TABLE_EXPERIMENT_WORDS = ["pollutant", "c0", "qe", "adsorption", "mg/l", "mg/g", "te_min", "slr", "cd", "pb", "cr(vi)"]
TOPIC_WORDS = ["biochar", "acid", "hcl", "hno3", "h2so4", "h3po4", "adsorption", "qe", "c0", "cd", "pb", "cr(vi)", "cu(ii)", "ni(ii)", "co(ii)"]
#: Kinds of record and the fields asked for.
FORMATS = {
    "biochar_modification": "sample_id, biomass_source, pyrolysis_temp_C, hold_duration_h, acid_type, acid_conc_mol_L, acid_time_h, acid_temp_C",
    "adsorption_experiment": "sample_id, pollutant_name, pH, T_K, Te_min, SLR_g_L, Qmax",
}
#: Classes of a table.
TABLE_CLASSES = ("crystal", "bond & angle", "coordinate", "property", "elemental composition")
END = "<END>"


@dataclass(frozen=True)
class Prompts:
    """What is asked; ``{text}`` is the element's text, ``{names}`` the kinds found and ``{formats}`` their fields."""

    classify: str = "Which of these does the paragraph hold: table, figure, synthesis condition, property, else? Answer with a list.\nParagraph: {text}"
    synthesis_kinds: str = "List the preparation steps that the paragraph states.\nParagraph: {text}"
    synthesis_records: str = "Give a JSON list of records with the values of: {names}.\nFields by kind: {formats}\nParagraph: {text}"
    property_kinds: str = "List the measured properties that the paragraph states.\nParagraph: {text}"
    property_records: str = "Give a JSON list of records with the values of: {names}.\nFields by kind: {formats}\nParagraph: {text}"
    table_markdown: str = "Rewrite the table in Markdown and close with " + END + ".\nTable: {text}"
    table_class: str = "Is the table of class " + ", ".join(TABLE_CLASSES) + "? Answer with one.\nTable: {text}"
    table_kinds: str = "List the kinds of value in the table's columns.\nTable: {text}"
    table_records: str = "Give a JSON list of records, one for each sample of the table, with: {names}.\nFields by kind: {formats}\nTable: {text}"


@dataclass
class Miner:
    """A backend and its prompts; ``kept`` replies are not asked for again, and all replies are gathered in ``answers``."""

    backend: seam.Backend
    second: seam.Backend | None = None
    prompts: Prompts = field(default_factory=Prompts)
    kept: DataFrame | None = None
    answers: list[DataFrame] = field(default_factory=list)

    def ask(self, rows: DataFrame, step: str, text: str, names: str | None = None, backend: seam.Backend | None = None) -> DataFrame:
        """``rows`` with ``reply, value, error`` of a step's prompt about a column of text."""
        prompt: Column = F.replace(F.lit(getattr(self.prompts, step)), F.lit("{formats}"), F.lit(json.dumps(FORMATS)))
        if names is not None:
            prompt = F.replace(prompt, F.lit("{names}"), F.array_join(F.col(names), ", "))
        prompt = F.replace(prompt, F.lit("{text}"), F.coalesce(F.col(text), F.lit("")))
        # written at once: a later step that reads the replies several times would ask for them as often
        answers = stage_table(seam.ask(rows.select("id", "idx", prompt.alias("_p")).withColumn("_key", F.struct("id", "idx")), "_key", "_p", backend or self.backend, self.kept), step)
        self.answers.append(answers.withColumn("step", F.lit(step)))
        found = answers.select(F.col("_key.id").alias("id"), F.col("_key.idx").alias("idx"), "reply", "value", "error")
        return stage_table(rows.join(found, ["id", "idx"], "left"), f"{step}-rows")


def _read(rows: DataFrame, name: str, rule: Callable[[str | None], list[str]], source: str = "reply") -> DataFrame:
    """A column of names read from each row's reply by a plain rule."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{name: [rule(None if r is None or r != r else r) for r in frame[source]]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, {name} array<string>")


def _value(reply: str | None) -> object:
    try:
        return replies.parse_reply(reply)
    except ValueError:
        return reply


def _names(reply: str | None) -> list[str]:
    return replies.names_of(_value(reply)) if reply else []


def likely_kinds(text: Column, experiment: Sequence[str] = EXPERIMENT_WORDS, numbers: bool = True) -> Column:
    """The kinds of record whose words a text has, with a number in it if asked."""
    has = T.has_number_about if numbers else (lambda c, words: F.size(T.keyword_hits(F.lower(F.coalesce(c, F.lit(""))), list(words))) > 0)
    found = [F.when(has(text, PREPARATION_WORDS), F.lit("biochar_modification")), F.when(has(text, experiment), F.lit("adsorption_experiment"))]
    return F.array_compact(F.array(*found))


def classify(elements: DataFrame, miner: Miner) -> DataFrame:
    """Elements (``id, idx, type, content``) with ``classes``: a table or figure is one, a text's are the model's; a failed call gives ``error``."""
    texts, others = elements.where("type = 'text'"), elements.where("type <> 'text'")
    asked = _read(miner.ask(texts, "classify", "content"), "classes", lambda r: replies.labels_of(_value(r)))
    asked = asked.withColumn("classes", F.when(F.col("reply").isNull(), F.array(F.lit("error"))).otherwise(F.col("classes")))
    return asked.select(*elements.columns, "classes").unionByName(others.withColumn("classes", F.array("type")))


def _records(rows: DataFrame, miner: Miner, kinds: str, records: str, boost: Column) -> DataFrame:
    """``id, idx, kinds, ord, row, error`` of rows asked first for kinds, then for records of them; where none is named, what the text's own words say."""
    named = _read(miner.ask(rows, kinds, "content"), "kinds", _names).drop("reply", "value", "error")
    named = named.withColumn("kinds", F.when(F.size("kinds") > 0, F.col("kinds")).otherwise(boost))
    asked = miner.ask(named.where(F.size("kinds") > 0), records, "content", "kinds")
    keyed = asked.withColumn("_key", F.struct("id", "idx"))
    found = seam.records_of(keyed, "_key").select(F.col("_key.id").alias("id"), F.col("_key.idx").alias("idx"), "ord", "row")
    return asked.select("id", "idx", "kinds", "error").join(found, ["id", "idx"], "left").select("id", "idx", "kinds", "ord", "row", "error")


def synthesis(elements: DataFrame, miner: Miner) -> DataFrame:
    """Records of the elements classed as synthesis conditions."""
    return _records(elements.where(F.array_contains("classes", "synthesis condition")), miner, "synthesis_kinds", "synthesis_records", likely_kinds(F.col("content")))


def properties(elements: DataFrame, miner: Miner) -> DataFrame:
    """Records of the elements classed as properties."""
    return _records(elements.where(F.array_contains("classes", "property")), miner, "property_kinds", "property_records", likely_kinds(F.col("content")))


def table_class(reply: str | None) -> list[str]:
    """The one class of a table that a reply names; none if it names another or several."""
    value = _value(reply)
    named = [str(v).strip().strip("'\"").lower() for v in (value if isinstance(value, list | tuple) else [value or ""])]
    return named if len(named) == 1 and named[0] in TABLE_CLASSES else []


def tables(elements: DataFrame, miner: Miner) -> DataFrame:
    """Records of tables: rewritten in Markdown (by the second backend where the end mark is missing), classed, and mined if of crystals or properties. A table of no known class has an error."""
    plain = elements.where(F.array_contains("classes", "table")).withColumn("content", T.plain_markup(F.col("content")))
    writer = seam.Fallback(miner.backend, miner.second or miner.backend, END)
    written = miner.ask(plain, "table_markdown", "content", backend=writer)
    written = written.withColumn("content", F.when(F.col("reply").contains(END), T.strip(F.split("reply", END)[0])).otherwise(F.col("content"))).drop("reply", "value", "error")
    classed = _read(miner.ask(written, "table_class", "content"), "table_class", table_class).drop("value", "error")
    unknown = classed.where(F.size("table_class") == 0)
    errors = unknown.select("id", "idx", F.array().cast("array<string>").alias("kinds"), F.lit(None).cast("int").alias("ord"), F.lit(None).cast("map<string, string>").alias("row"), F.concat(F.lit("no class of a table: "), F.coalesce("reply", F.lit("no reply"))).alias("error"))
    wanted = classed.where("array_contains(table_class, 'crystal') or array_contains(table_class, 'property')").drop("reply", "table_class")
    return _records(wanted, miner, "table_kinds", "table_records", likely_kinds(F.col("content"), TABLE_EXPERIMENT_WORDS, numbers=False)).unionByName(errors)


def mine(elements: DataFrame, miner: Miner, most_tokens: int = 2000) -> DataFrame:
    """All records of articles' elements: ``id, idx, source, kinds, ord, row, error``.

    Texts are classified, neighbours of one class packed, then mined by class. A classified paragraph of whose pack no
    record came is mined on its own, since packing can drown its numbers.
    """
    classed = classify(elements, miner)
    single = classed.where("type = 'text'").withColumn("_class", F.array_join("classes", ",")).where("_class not in ('else', 'error')")
    packs = seam.pack(single, "id", "idx", "content", most_tokens, "_class", "_class").select("id", F.col("first").alias("idx"), "last", F.lit("text").alias("type"), F.col("text").alias("content"), F.split("kind", ",").alias("classes"))
    parts = []
    for name, step in (("synthesis", synthesis), ("property", properties)):
        found = step(packs, miner)
        parts.append(found.withColumn("source", F.lit(name)))
        label = "synthesis condition" if name == "synthesis" else "property"
        empty = packs.where(F.array_contains("classes", label)).join(found.where("row is not null").select("id", "idx").distinct(), ["id", "idx"], "left_anti")
        again = classed.join(empty.where("last > idx").select("id", F.col("idx").alias("_from"), F.col("last").alias("_to")), "id").where("type = 'text' and idx between _from and _to").drop("_from", "_to")
        parts.append(step(again, miner).withColumn("source", F.lit(f"{name}, single")))
    parts.append(tables(classed, miner).withColumn("source", F.lit("table")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", "idx", "source", "kinds", "ord", "row", "error")
