"""Chat formatting by perspective rotation, in expressions only.

For every participant of a dialogue the whole dialogue is rendered with that speaker
as the assistant and everyone else as a named user; the mask covers what the
assistant says. Turns meet in one shuffle by dialogue, in which running sums give the
place of each turn for its own speaker; the gathered turns are then rendered once for
each participant. All steps are linear in the turns rendered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Roles that set the scene: rendered under their own name, never as a participant.
SCENE = ("system",)


def _plain(text: Column) -> Column:
    """Text in which no control string can be read."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(BEGIN), F.lit("<|im_start >")), F.lit(END), F.lit("<|im_end >"))


def _name(role: Column) -> Column:
    return F.coalesce(F.regexp_replace(_plain(role), r"[ \t\r\n]+", "_"), F.lit(""))


def rotate_perspectives(turns: DataFrame, scene: Sequence[str] = SCENE) -> DataFrame:
    """Columns ``conv_id, speaker, turns, text, mask``: a row for each participant of each dialogue, however long.

    ``mask`` lists ``start:stop`` character ranges of ``text``, with commas between: what the
    assistant says, its end mark included. Turns are in the order of their number, then
    role and text; those without a number come last. A null
    role is a user named ``unknown`` and no participant; a null text is empty. A row without
    a conv_id is a dialogue of its own. Repeated rows are repeated turns. A dialogue of scene
    roles alone has no participant and no row. Control strings in texts and names are
    defused. Other columns are ignored; an empty table has an empty result.
    """
    scenes = F.array(*[F.lit(s) for s in scene]).cast("array<string>")
    own = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    speaks = F.col("role").isNotNull() & ~F.array_contains(scenes, F.col("role"))
    who = F.when(F.col("role").isNull(), F.lit("user name=unknown")).when(speaks, F.concat(F.lit("user name="), _name(F.col("role")))).otherwise(_name(F.col("role")))
    own = own.select("conv_id", "turn", "role", "text", speaks.alias("speaks"), who.alias("who"), F.concat(_plain(F.col("text")), F.lit(END)).alias("body"))
    # characters of a turn as a named user's; for its own speaker every turn of theirs is shorter or longer by the same
    size = (F.length("who") + F.length("body") + len(BEGIN) + 2).cast("long")
    less = F.length("who") - len("assistant")
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]

    def placed(table: DataFrame, before: Column, earlier: Column, at: Column) -> DataFrame:
        start = before - less * earlier + (len(BEGIN) + len("assistant") + 1)
        piece = F.struct(at.alias("at"), "role", "who", "body", F.concat(start.cast("string"), F.lit(":"), (start + F.length("body")).cast("string")).alias("span"))
        return table.select("conv_id", F.when(F.col("speaks"), F.col("role")).alias("speaker"), piece.alias("piece"))

    every = Window.partitionBy("conv_id").orderBy("at")
    same = Window.partitionBy("conv_id", "role").orderBy("at")
    numbered = own.where("conv_id is not null").withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    numbered = numbered.withColumn("before", F.sum(size).over(every.rowsBetween(Window.unboundedPreceding, 0)) - size).withColumn("earlier", F.row_number().over(same) - 1)
    gathered = placed(numbered, F.col("before"), F.col("earlier"), F.col("at")).groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("_turns"), F.collect_set("speaker").alias("_speakers"))
    lone = placed(own.where("conv_id is null"), F.lit(0), F.lit(0), F.lit(1)).select("conv_id", F.array("piece").alias("_turns"), F.array_compact(F.array("speaker")).alias("_speakers"))
    both = gathered.unionByName(lone).select("conv_id", "_turns", F.explode("_speakers").alias("speaker"))

    def rendered(t: Column) -> Column:
        return F.concat(F.lit(BEGIN), F.when(t.role.eqNullSafe(F.col("speaker")), F.lit("assistant")).otherwise(t.who), F.lit("\n"), t.body, F.lit("\n"))

    mask = F.array_join(F.transform(F.filter("_turns", lambda t: t.role.eqNullSafe(F.col("speaker"))), lambda t: t.span), ",")
    return both.select("conv_id", "speaker", F.size("_turns").alias("turns"), F.array_join(F.transform("_turns", rendered), "").alias("text"), mask.alias("mask"))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from every participant's perspective."""
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'row ' || row_number() OVER ()) AS dialogue, turn, role,
    replace(replace(coalesce(text, ''), '<|im_start|>', '<|im_start >'), '<|im_end|>', '<|im_end >') AS text, text AS raw FROM conversations
), s AS (SELECT DISTINCT dialogue, role AS speaker FROM t WHERE role IS NOT NULL AND role <> 'system'),
p AS (
  SELECT t.dialogue, conv_id, speaker, turn, role, raw, role IS NOT DISTINCT FROM speaker AS said,
    '<|im_start|>' || CASE WHEN role IS NULL THEN 'user name=unknown' WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
      ELSE 'user name=' || regexp_replace(replace(replace(role, '<|im_start|>', '<|im_start >'), '<|im_end|>', '<|im_end >'), '[ \t\r\n]+', '_', 'g') END || chr(10) AS head,
    text || '<|im_end|>' AS body
  FROM t JOIN s ON t.dialogue = s.dialogue
), o AS (
  SELECT *, row_number() OVER w AS rn, coalesce(sum(len(head) + len(body) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM p WINDOW w AS (PARTITION BY dialogue, speaker ORDER BY turn NULLS LAST, role NULLS FIRST, raw NULLS FIRST)
)
SELECT conv_id, speaker, CAST(count(*) AS INTEGER) AS turns, string_agg(head || body || chr(10), '' ORDER BY rn) AS text,
  coalesce(string_agg(CAST(pos + len(head) AS BIGINT) || ':' || CAST(pos + len(head) + len(body) AS BIGINT), ',' ORDER BY rn) FILTER (WHERE said), '') AS mask
FROM o GROUP BY dialogue, conv_id, speaker
"""
