"""Multi-party perspective rotation of conversations.

Each participant of a conversation (a role that speaks in it; system texts are
not a participant's) is the assistant once: the dialogue is rendered with that
speaker's turns as assistant, everyone else's as user with the speaker's name,
system turns as system, and a mask of 1 on the characters to learn from, the
assistant's texts and their closing mark. Rows are messages, in the order of
turn, with the place of each message in the rendered text; joined in that order
they are the text. A conversation is never gathered: its participants are a
pre-aggregated row, and places are running sums over blocks of BLOCK turns, so a
conversation of any length spreads over tasks.

Rendered form: <|role|> or <|user:name|>, a line end, the text, <|end|>, a line end.

Defined cases: a null conv_id is no conversation (no rows); a null turn counts as
the first, a null role as the speaker "unknown", a null text as empty; turns of
one number are ordered by role, then text; equal rows are said once each; a
conversation of system turns alone has no participants and no rows; marks in a
text or a name are escaped by a zero-width space, and a name's line ends are spaces, so that
neither can end a message or a header; other columns are not read, whatever their names; texts of
any length are rendered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import keep

BLOCK = 256
ASSISTANT, USER, SYSTEM, UNKNOWN = "assistant", "user", "system", "unknown"


def perspectives(conversations: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, role, name, rendered, start, mask_start, mask_end): a row for each message of each rotation.

    start is the message's place in the rotation's text, in characters; its mask is 1 from mask_start to mask_end (equal: none).
    """
    said = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN)).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    said = said.withColumn("text", F.replace("text", F.lit("<|"), F.lit("<​|")))
    # Messages are ranked within blocks of turns; a turn's messages stay in one block.
    said = said.withColumn("block", F.floor(F.col("turn") / BLOCK))
    ranked = said.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "speaker", "text")))
    ranked = keep(ranked, "turns")
    people = ranked.where(F.col("speaker") != SYSTEM).groupBy("conv_id").agg(F.array_sort(F.collect_set("speaker")).alias("people"))
    rows = ranked.join(people, "conv_id").withColumn("perspective", F.explode("people")).drop("people")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, ASSISTANT).otherwise(USER)
    name = F.when(role == USER, F.col("speaker"))
    # A name stays within its header, whatever it holds.
    safe = F.replace(F.replace(F.translate(name, "\r\n", "  "), F.lit("<|"), F.lit("<\u200b|")), F.lit("|>"), F.lit("|\u200b>"))
    head = F.concat(F.lit("<|"), role, F.coalesce(F.concat(F.lit(":"), safe), F.lit("")), F.lit("|>\n"))
    rows = rows.select("conv_id", "perspective", "block", "rank", "turn", role.alias("role"), name.alias("name"), F.length(head).alias("head"), F.concat(head, "text", F.lit("<|end|>\n")).alias("rendered"))
    sizes = rows.groupBy("conv_id", "perspective", "block").agg(F.sum(F.length("rendered")).alias("size"))
    listed = sizes.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(F.struct("block", "size"))).alias("blocks"))
    running = F.aggregate("blocks", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["size"])))
    starts = listed.select("conv_id", "perspective", F.arrays_zip(F.col("blocks.block").alias("block"), running.alias("at")).alias("z")).select("conv_id", "perspective", F.explode("z").alias("z")).where("z.block is not null").select("conv_id", "perspective", "z.block", "z.at")
    before = Window.partitionBy("conv_id", "perspective", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0))).join(starts, ["conv_id", "perspective", "block"])
    start = F.col("at") + F.col("before")
    learn = F.col("role") == ASSISTANT
    return placed.select("conv_id", "perspective", "turn", "role", "name", "rendered", start.alias("start"), (start + F.when(learn, F.col("head")).otherwise(0)).alias("mask_start"), (start + F.when(learn, F.length("rendered") - 1).otherwise(0)).alias("mask_end"))


ORACLE = r"""
WITH said AS (SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS speaker,
                     replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS text
              FROM conversations WHERE conv_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, speaker, text) AS rank FROM said),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
msg AS (SELECT r.conv_id, p.perspective, r.turn, r.rank,
               CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
               CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name, r.text
        FROM ranked r JOIN people p USING (conv_id)),
headed AS (SELECT *, '<|' || role || coalesce(':' || replace(replace(translate(name, chr(13) || chr(10), '  '), '<|', '<' || chr(8203) || '|'), '|>', '|' || chr(8203) || '>'), '') || '|>' || chr(10) AS head FROM msg),
full_text AS (SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM headed),
placed AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY rank
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM full_text)
SELECT conv_id, perspective, turn, role, name, rendered, start,
       start + CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END AS mask_start,
       start + CASE WHEN role = 'assistant' THEN length(rendered) - 1 ELSE 0 END AS mask_end
FROM placed
"""
