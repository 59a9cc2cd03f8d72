"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

Every speaker of a conversation but ``system`` gets a rendering of the whole dialogue in which that speaker is the assistant, the
system turns stay and all others are users with their names. A rendering is the concatenation of its segments in order of
position; the table has a row a segment, with its place in characters and the span that training should predict (the speaker's
own words and the end mark), so a conversation of any length is spread over rows instead of gathered in one.

Places are running sums in two steps, within blocks of TURNS turn numbers and over the blocks' totals, and the turns of conversations
that hold much of the table are dealt out, each part with its own copy of the speakers, so that such a conversation doesn't meet in
one task.

Defined cases: null text counts as empty; a null role is a speaker of its own, rendered as ``unknown`` and not the speaker of that
name; turns with equal numbers are ordered by role and text, nulls first; repeated rows are turns of their own; rows without
conv_id are one conversation; a conversation with system turns alone has no speakers and no rows; text and names that imitate a mark
are rendered with an underscore in it, and line breaks in names as blanks. Equal turn numbers, and null ones, make one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import HOT, partitions

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS = 64
_FIRST = -(2**62)


def _harmless(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("<|_im_"))


def rotations(conversations: DataFrame, turns: int = TURNS, hot: float = HOT) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, role, segment, char_start, char_end, mask_start, mask_end."""
    said = conversations.select(
        "conv_id", "turn", F.col("role").alias("speaker"), _harmless(F.col("text")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / turns).cast("bigint"), F.lit(_FIRST)).alias("block"),
    )
    # There can't be more than 1 / hot such conversations.
    sizes = conversations.groupBy(F.col("conv_id").alias("large")).count()
    large = F.broadcast(sizes.crossJoin(conversations.agg(F.count("*").alias("all"))).where(F.col("count") > F.col("all") * hot).select("large", F.lit(True).alias("is_large")))
    parts = partitions(conversations.sparkSession)
    part = F.when(F.col("is_large"), F.pmod(F.xxhash64("turn", "speaker", "text"), F.lit(parts))).otherwise(0)
    said = said.join(large, F.col("conv_id").eqNullSafe(F.col("large")), "left").withColumn("part", part).drop("large", "is_large")
    speakers = conversations.where(~F.col("role").eqNullSafe("system")).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    every = F.when(F.col("is_large"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))).cast("array<bigint>")
    speakers = speakers.join(large, F.col("of").eqNullSafe(F.col("large")), "left").select("of", "perspective", F.explode(every).alias("of_part"))
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    role = F.when(F.col("speaker") == "system", "system").when(own, "assistant").otherwise("user")
    name = F.translate(_harmless(F.coalesce("speaker", F.lit("unknown"))), "\r\n", "  ")
    head = F.concat(F.lit(OPEN), role, F.when(role == "user", F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))
    rows = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).drop("of", "part", "of_part")
    rows = rows.withColumns({"own": own, "role": role, "head": F.char_length(head).cast("bigint"), "segment": F.concat(head, "text", F.lit(CLOSE + "\n"))})
    rows = rows.withColumn("size", F.char_length("segment").cast("bigint")).drop("text")
    keys = ["conv_id", "perspective", "block"]
    order = Window.partitionBy(*keys).orderBy("turn", "speaker", "segment")
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(k).alias(f"{k}_") for k in keys], *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in ("n", "s")])
    placed = rows.withColumns({"k": F.row_number().over(order), "to": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    placed = placed.join(bases, F.col("conv_id").eqNullSafe(F.col("conv_id_")) & F.col("perspective").eqNullSafe(F.col("perspective_")) & (F.col("block") == F.col("block_")))
    start = F.col("base_s") + F.col("to") - F.col("size")
    return placed.select(
        "conv_id", "perspective", (F.col("base_n") + F.col("k") - 1).alias("position"), "turn", "speaker", "role", "segment", start.alias("char_start"), (start + F.col("size")).alias("char_end"),
        F.when(F.col("own"), start + F.col("head")).alias("mask_start"), F.when(F.col("own"), start + F.col("size") - 1).alias("mask_end"),
    )


def renderings(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, the whole rendering and the spans (start, end) to predict, a row each: for conversations that fit a row."""
    at = F.struct("position", "segment", F.struct(F.col("mask_start").alias("start"), F.col("mask_end").alias("end")).alias("span"))
    rows = rotations(conversations).groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(at)).alias("all"))
    spans = F.filter(F.col("all.span"), lambda s: s["start"].isNotNull())
    return rows.select("conv_id", "perspective", F.array_join("all.segment", "").alias("rendering"), spans.alias("spans"))


def op9(conversations: DataFrame) -> DataFrame:
    """Every segment of every rendering of every conversation."""
    return rotations(conversations)


SQL = """
WITH said AS (
  SELECT conv_id, turn, role AS speaker, replace(coalesce(text, ''), '<|im_', '<|_im_') AS text,
    translate(replace(coalesce(role, 'unknown'), '<|im_', '<|_im_'), chr(13) || chr(10), '  ') AS name FROM conversations),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker IS DISTINCT FROM 'system'),
framed AS (
  SELECT s.conv_id, p.perspective, s.turn, s.speaker, s.name, s.text, s.speaker IS NOT DISTINCT FROM p.perspective AS own,
    CASE WHEN s.speaker = 'system' THEN 'system' WHEN s.speaker IS NOT DISTINCT FROM p.perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || name ELSE '' END || chr(10) AS head FROM framed),
sized AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS segment, CAST(length(head || text || '<|im_end|>' || chr(10)) AS BIGINT) AS size FROM headed),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position, CAST(sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end
  FROM sized WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, segment))
SELECT conv_id, perspective, position, turn, speaker, role, segment, char_end - size AS char_start, char_end,
  CASE WHEN own THEN char_end - size + length(head) END AS mask_start, CASE WHEN own THEN char_end - 1 END AS mask_end
FROM placed
"""
