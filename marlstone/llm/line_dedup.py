"""Line dedup by a log-template tree, in expressions only.

Every line goes down a tree of fixed depth: its token count, then its leading tokens, a
token with a digit counting as a variable. At the leaf, fields are generalised by one rule,
whatever the length of the line. The support of a line is the number of documents in which more than half of
its tokens are met at their places at the leaf; a token met there in fewer than half as many
documents is a variable. What stays fixed, with the leaf, is a template. A template met
in several documents is recurring; its lines stay in the first document and are dropped
from all others. A line of which not more than half are tokens without a digit says too little as a
template and is its own key, digits and all.

Most leaves have the lines of one template, or of one document, and need no counts. So leaves with several
different lines in several documents are told first, and only the distinct lines of
these fall into tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.heavy import join_by_key
from marlstone.llm.sharding import let
from marlstone.llm.storage import stage_table

#: Leading tokens of the tree.
DEPTH = 3
#: Rows of 64 bits of the filter of leaves: a table of no more rows than this, whatever the corpus.
FILTER_ROWS = 1 << 17
_SPACE = " \\t\\x0B\\f\\r"
_FIELD = "\u0001"
_DOC = ["_id", "_anon"]


def _two_hashes(name: str, *columns: Column | str) -> list[Column]:
    """128 bits of hash as two columns: tables of 10^13 keys have no collision to speak of."""
    return [F.xxhash64(*columns).alias(f"{name}a"), F.xxhash64(F.lit(1), *columns).alias(f"{name}b")]


def line_parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each line that is not blank.

    ``_id, _anon`` (its document), ``_pos``, ``_ka, _kb`` (its key before fields are generalised), ``_lead`` (hash of the leaf, null for a line
    that is its own key) and ``_m`` (the tokens, joined by spaces, variables as one mark).
    """
    text = F.col(text_col).cast("string")
    # the hash of a text is taken before the text falls into lines, not once for each of them
    whole = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_anon"), text.alias("_whole"))
    lines = whole.select(*_DOC, F.posexplode(F.split("_whole", "\n")).alias("_pos", "_text"))
    digits = F.col("_text").rlike("[0-9]")
    # each token is met once: a match begins after space or at the start, and no run is given back
    masked = F.when(digits, F.regexp_replace("_text", f"(?<![^{_SPACE}])[^{_SPACE}0-9]*+[0-9][^{_SPACE}]*+", _FIELD)).otherwise(F.col("_text"))
    lines = lines.select(*_DOC, "_pos", "_text", digits.alias("_d"), F.btrim(masked, F.lit(" \t\x0b\f\r")).alias("_m")).where("_m <> ''")
    lines = lines.select(*_DOC, "_pos", "_text", "_d", F.split("_m", f"[{_SPACE}]+").alias("_t"))
    n = F.size("_t")
    words = F.when(F.col("_d"), F.size(F.array_remove("_t", _FIELD))).otherwise(n)
    lines = lines.select(*_DOC, "_pos", "_text", "_t", n.alias("_n"), (words * 2 > n).alias("_ok"))
    key = [F.when(F.col("_ok"), m).otherwise(x).alias(c) for m, x, c in zip(_two_hashes("_m", F.lit(-1), "_t"), _two_hashes("_x", F.lit(-2), "_text"), ("_ka", "_kb"), strict=True)]
    lead = F.when(F.col("_ok"), F.xxhash64("_n", F.slice("_t", 1, DEPTH)))
    return lines.select(*_DOC, "_pos", *key, lead.alias("_lead"), F.when(F.col("_ok"), F.array_join("_t", " ")).alias("_m"))


def _one_document() -> Column:
    """A hash of the document: enough to see that there are several; a false meeting costs work, no line."""
    return F.when(F.col("_id").isNull(), F.col("_anon")).otherwise(F.xxhash64("_id"))


def _of_leaves(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """The lines that may be at one of the leaves, by a filter of ``64 * FILTER_ROWS`` bits; others may be among them."""
    slot, bit = F.pmod("_lead", F.lit(FILTER_ROWS)).alias("_slot"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright("_lead", 40), F.lit(64)).cast("int"))
    bits = leaves.select(slot, bit.alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    # FILTER_ROWS rows of two numbers at most
    met = lines.withColumn("_slot", F.pmod("_lead", F.lit(FILTER_ROWS))).join(F.broadcast(bits), "_slot").where(F.col("_bits").bitwiseAND(bit) != 0)
    return met.drop("_slot", "_bits")


def generalised(parts: DataFrame) -> DataFrame:
    """``_ka, _kb, _ta, _tb, _count``: for the keys of lines at leaves with several lines the key of their template, and the number of such lines."""
    lines = parts.where("_lead is not null")
    leaves = lines.groupBy("_lead").agg(F.min("_ka").alias("_lo"), F.max("_ka").alias("_hi"), F.min(_one_document()).alias("_a"), F.max(_one_document()).alias("_b"), F.count("*").alias("_count"))
    # a token under half of the support needs a support of three
    leaves = stage_table(leaves.where("_lo < _hi and _a < _b and _count >= 3").select("_lead", "_count"), "leaves")
    near = join_by_key(_of_leaves(lines, leaves), leaves, ["_lead"], "_count", lines.count())
    each = near.groupBy("_lead", "_ka", "_kb", *_DOC).agg(F.count("*").alias("_times"), F.any_value("_m").alias("_m"))
    shapes = each.groupBy("_lead", "_ka", "_kb").agg(F.count("*").alias("_docs"), F.sum("_times").alias("_count"), F.any_value("_m").alias("_m"))
    shapes = stage_table(shapes, "shapes")
    tokens = shapes.select("_lead", "_ka", "_kb", "_docs", F.posexplode(F.split("_m", " ")).alias("_at", "_w"))
    words = tokens.where(F.col("_w") != _FIELD)
    met = stage_table(words.groupBy("_lead", "_at", "_w").agg(F.sum("_docs").alias("_in"), F.count("*").alias("_rows")), "tokens")
    total = met.agg(F.sum("_rows")).first()[0] or 0
    counted = join_by_key(words.drop("_docs"), met, ["_lead", "_at", "_w"], "_rows", total)
    # an array as long as the line
    lists = counted.groupBy("_lead", "_ka", "_kb").agg(F.collect_list(F.struct("_at", "_w", "_in")).alias("_l"))
    number = shapes.select("_ka", "_kb", F.size(F.split("_m", " ")).alias("_n"), "_count")
    lists = lists.join(number, ["_ka", "_kb"])
    # what more than half of all tokens reach, computed once a line, and so is what stays fixed
    support = F.get(F.sort_array(F.transform("_l", lambda x: x["_in"]), asc=False), F.floor(F.col("_n") / 2).cast("int"))

    def key(fixed: Column) -> Column:
        return F.struct(*_two_hashes("_t", F.lit(-3), "_lead", "_n", fixed))

    fixed = let(support, lambda s: F.array_sort(F.transform(F.filter("_l", lambda x: x["_in"] * 2 >= s), lambda x: F.struct(x["_at"].alias("at"), x["_w"].alias("w")))))
    return lists.select("_ka", "_kb", let(fixed, key).alias("_key"), "_count").select("_ka", "_kb", "_key._ta", "_key._tb", "_count")


def line_templates(parts: DataFrame) -> DataFrame:
    """``_id, _anon, _pos, _ka, _kb``: the key of the template of every line of ``line_parts``."""
    keys = stage_table(generalised(parts), "generalised")
    met = join_by_key(parts.select(*_DOC, "_pos", "_ka", "_kb"), keys, ["_ka", "_kb"], "_count", parts.count(), "left")
    return met.select(*_DOC, "_pos", F.coalesce("_ta", "_ka").alias("_ka"), F.coalesce("_tb", "_kb").alias("_kb"))


def _met() -> list[Column]:
    """What tells whether the rows of a key are of several documents, and which of these is the first: the least id, or without ids the least hash of a text."""
    without = F.when(F.col("_id").isNull(), F.col("_anon"))
    return [F.min("_id").alias("_owner"), F.max("_id").alias("_last"), F.min(without).alias("_first_anon"), F.max(without).alias("_last_anon"), F.count("*").alias("_count")]


_SEVERAL = "_owner < _last or (_owner is not null and _first_anon is not null) or _first_anon < _last_anon"


def recurring(keys: DataFrame) -> DataFrame:
    """``_ka, _kb, _owner, _first_anon, _count`` of the keys that several documents have."""
    return keys.groupBy("_ka", "_kb").agg(*_met()).where(_SEVERAL).select("_ka", "_kb", "_owner", "_first_anon", "_count")


def count_names(columns: list[str]) -> tuple[str, str]:
    """Names of the two counts beside the given columns: ``lines`` and ``dropped_lines``, underscores appended while a column has the name."""
    names = []
    for name in ("lines", "dropped_lines"):
        while name in columns:
            name += "_"
        names.append(name)
    return names[0], names[1]


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with recurring lines taken out of the text, and two columns more: ``lines`` and ``dropped_lines`` (see ``count_names`` where ``docs`` has such columns).

    Lines end at ``\\n``. Null texts stay null with no lines; an empty text has one
    empty line and stays, as do blank lines. Documents
    are told apart by id, a number or a string: rows of one id count as one document and
    a repetition within it drops nothing. Of rows without an id, those of equal text are
    one document; these come after all with an id, in the order of a hash. All other columns and rows stay as they are;
    an empty table has an empty result. Keys are hashes of 128 bits.
    """
    lines_as, dropped_as = count_names(docs.columns)
    parts = stage_table(line_parts(docs, id_col, text_col), "lines")
    keys = stage_table(line_templates(parts), "templates")
    owners = stage_table(recurring(keys), "owners")
    met = join_by_key(keys, owners, ["_ka", "_kb"], "_count", keys.count())
    later = "_id > _owner or (_id is null and (_owner is not null or _anon > _first_anon))"
    drops = stage_table(met.where(later).groupBy(*_DOC).agg(F.collect_set("_pos").alias("_drops")), "drops")
    drops = drops.select(F.col("_id").alias("_of"), F.col("_anon").alias("_like"), "_drops")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_anon"))
    rows = rows.join(drops, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_anon") == F.col("_like")), "left")
    text = F.col("_row")[text_col]
    lines = F.split(text, "\n")
    number = F.when(text.isNull(), 0).otherwise(F.size(lines))
    # the places that stay, by one set difference, and their lines
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drops"), lambda p: F.get("_lines", p))
    rows = rows.select("_row", "_drops", number.cast("long").alias("_number"), F.when(F.col("_drops").isNotNull(), lines).alias("_lines"))
    new = F.when(F.col("_drops").isNull(), text).otherwise(F.array_join(kept, "\n"))
    columns = [new.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns]
    return rows.select(*columns, F.col("_number").alias(lines_as), F.when(F.col("_drops").isNull(), 0).otherwise(F.size("_drops")).cast("long").alias(dropped_as))


def op10_line_template_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their recurring lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring_lines(docs)


#: The rules over plain token lists, at all leaves and without hashes.
OP10_SQL = r"""
WITH l AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
t AS (SELECT DISTINCT doc_id, line, list_filter(string_split_regex(regexp_replace(line, '[^ \t\x0B\f\r0-9]*[0-9][^ \t\x0B\f\r]*', chr(1), 'g'), '[ \t\x0B\f\r]+'), lambda x: x <> '') AS t FROM l),
n AS (SELECT *, len(t) AS n, 2 * len(list_filter(t, lambda x: x <> chr(1))) > len(t) AS ok FROM t WHERE len(t) > 0),
m AS (SELECT DISTINCT doc_id, t, n, n || '|' || array_to_string(t[1:3], ' ') AS leaf FROM n WHERE ok),
w AS (SELECT leaf, t, n, k, t[k] AS w FROM (SELECT leaf, t, n, unnest(range(1, n + 1)) AS k FROM m) WHERE t[k] <> chr(1)),
c AS (SELECT leaf, k, w, count(*) AS c FROM w GROUP BY ALL),
g AS (SELECT leaf, t, any_value(n) AS n, list({'k': k, 'w': w, 'c': c} ORDER BY k) AS f FROM (SELECT DISTINCT leaf, t, n, k, w FROM w) JOIN c USING (leaf, k, w) GROUP BY leaf, t),
h AS (SELECT t, leaf, f, list_reverse_sort(list_transform(f, lambda x: x.c))[n // 2 + 1] AS s FROM g),
k AS (SELECT t, 'template|' || leaf || '|' || array_to_string(list_transform(list_filter(f, lambda x: 2 * x.c >= s), lambda x: x.k || ' ' || x.w), ' ') AS key FROM h),
x AS (SELECT doc_id, line, CASE WHEN ok THEN key ELSE 'line|' || line END AS key FROM n LEFT JOIN k USING (t)),
o AS (SELECT key, min(doc_id) AS owner FROM x GROUP BY key HAVING min(doc_id) < max(doc_id)),
d AS (SELECT DISTINCT doc_id, line FROM x JOIN o USING (key) WHERE doc_id > owner),
r AS (SELECT l.doc_id, count(*) AS lines, count(d.line) AS dropped_lines, string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE d.line IS NULL) AS text
  FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.line = d.line GROUP BY l.doc_id)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, coalesce(lines, 0) AS lines, coalesce(dropped_lines, 0) AS dropped_lines
FROM documents LEFT JOIN r USING (doc_id)
"""
