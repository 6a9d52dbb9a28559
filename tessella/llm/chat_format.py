"""Chat formatting: multi-party perspective rotation, by DataFrame functions only.

For every participant (every role but system) the dialogue is rendered with that participant as assistant, all
others as users named by their role, and the system's turns as system. The rendering is a table of segments, one
per perspective and turn: header, content and end mark, with the segment's place in the rendered dialogue and the
span that a loss mask keeps, which is content and end mark of the assistant's segments. Concatenating a
perspective's segments by seq gives its text; no task holds a whole dialogue as a string, and the running offsets
are summed by blocks of turns, so one conversation with a third of all rows is spread over many tasks.

Null conv_ids form a conversation of their own; a null role is a participant of its own named "unknown"; a null turn
comes first; a null text is empty; turns that repeat are ordered by role and text and all kept; a conversation of system
turns alone has no perspective; further columns are ignored; an empty table gives an empty result. A role of letters, digits and "_.-" is its participant's name; others
are percent-encoded, so a name cannot end a header and no two roles share one. Marks of the format inside a text get a
blank in their middle, so a text cannot end its turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import common

SYSTEM, UNKNOWN = "system", "unknown"
PLAIN = r"^[\p{L}\p{N}_.-]+$"
HEAD, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Turns of a conversation that one block of the running sums holds.
BLOCK = 1024


def speaker_of(role: Column) -> Column:
    """A name for each role, none for two; what is encoded holds "%", "+" or "*", and so does a role called like none."""
    plain = role.rlike(PLAIN) & (role != UNKNOWN)
    return F.when(role.isNull(), F.lit(UNKNOWN)).when(plain, role).when(role == UNKNOWN, F.lit(f"%{UNKNOWN}")).otherwise(F.concat(F.url_encode(role), F.when(role.rlike("^[A-Za-z0-9]*$"), "%").otherwise("")))


def harmless(text: Column) -> Column:
    """The text without marks of the format."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "<| $1|>")


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, turn, speaker, chat_role, segment, seg_start, seg_end, mask_start, mask_end.

    Offsets are code points of the perspective's whole text; mask_start and mask_end are null outside the loss.
    The perspectives of a conversation are as many as its participants, so rows are turns times participants.
    """
    t = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), speaker_of(F.col(role)).alias("speaker"), harmless(F.col(text)).alias("text"))
    people = t.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    rows = t.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    mine = F.col("speaker") == F.col("perspective")
    chat = F.when(F.col("speaker") == SYSTEM, F.lit("system")).when(mine, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(chat == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(F.lit(""))
    head = F.concat(F.lit(HEAD), chat, name, F.lit(BREAK))
    rows = rows.select("conv_id", "perspective", "turn", "speaker", chat.alias("chat_role"), F.concat(head, F.col("text"), F.lit(END)).alias("segment"), F.length(head).alias("head"))
    rows = rows.withColumn("n", F.length("segment").cast("long")).withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / BLOCK))
    order = [F.col("turn").asc_nulls_first(), "speaker", "segment"]
    first = F.when(F.col("turn").isNull(), F.lit(None)).otherwise(F.col("block"))  # null turns are a block before all others
    rows = rows.withColumn("block", first)
    keys = ["conv_id", "perspective"]
    sums = rows.groupBy(*keys, "block").agg(F.sum("n").alias("size"))
    sums = sums.withColumn("base", F.sum("size").over(W.partitionBy(*keys).orderBy(F.col("block").asc_nulls_first())) - F.col("size")).withColumnsRenamed({"conv_id": "c", "perspective": "p", "block": "b"}).drop("size")
    at = F.sum("n").over(W.partitionBy(*keys, "block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & F.col("block").eqNullSafe(F.col("b"))
    out = rows.withColumn("upto", at).join(sums, same).withColumn("seg_end", F.col("base") + F.col("upto")).withColumn("seg_start", F.col("seg_end") - F.col("n"))
    kept = F.col("chat_role") == "assistant"
    return out.select("conv_id", "perspective", "turn", "speaker", "chat_role", "segment", "seg_start", "seg_end", F.when(kept, F.col("seg_start") + F.col("head")).alias("mask_start"), F.when(kept, F.col("seg_end")).alias("mask_end"))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(common.table_path(sf_dir, "conversations")))


OP2_SQL = r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(role, 'unknown'), '[^\p{L}\p{N}_.-]', '_', 'g') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.conv_id, perspective, turn, speaker, text, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM r),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, (sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment ROWS UNBOUNDED PRECEDING))::BIGINT AS seg_end FROM s)
SELECT conv_id, perspective, turn, speaker, chat_role, segment, seg_end - length(segment) AS seg_start, seg_end,
       CASE WHEN chat_role = 'assistant' THEN seg_end - length(segment) + length(head) END AS mask_start,
       CASE WHEN chat_role = 'assistant' THEN seg_end END AS mask_end
FROM o
"""
