"""Preference formatting: a shared prompt and two masked completions, by DataFrame operations alone.

A pair is a chosen and a rejected conversation.  Their longest common turn
prefix is rendered once, as prompt; what follows it in either is that side's
completion, of which only the assistant's turns count in the loss.  Results are
rows of one turn each, so no conversation is ever gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sharding import numbered
from .stages import stored

#: Fixed values of the chat format.
OPEN, NEWLINE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
ANSWERING = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(NEWLINE), text, F.lit(CLOSE))


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, place, role, text: rows of one turn number get places by role and text; nulls in both are empty."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return rows.where("conv_id IS NOT NULL").withColumn("place", place)


def pairs_of(conversations: DataFrame) -> DataFrame:
    """chosen, rejected: each conversation with the next one, by id, that opens with the same turn.

    Conversations are numbered in the order of their first turn and id, over
    ranges that may split a very common first turn, and meet their neighbours
    by number; so pairs are fewer than conversations, whatever the turns.
    Rows without a conversation count for nothing, null roles and texts as
    empty, repeated rows as turns of their own; no conversations, no pairs.
    """
    return _neighbours(_turns(conversations))


def _neighbours(turns: DataFrame) -> DataFrame:
    turns = turns.withColumn("opening", F.sha2(F.to_json(F.array("role", "text")), 256))
    first = turns.groupBy("conv_id").agg(F.min(F.struct(F.coalesce("turn", F.lit(-(1 << 62))), "place", "opening")).alias("first"))
    convs = numbered(first.select(F.col("first.opening").alias("opening"), "conv_id"), ["opening", "conv_id"])
    after = convs.select((F.col("row_number") - 1).alias("row_number"), F.col("opening").alias("next_opening"), F.col("conv_id").alias("rejected"))
    return convs.join(after, "row_number").where("opening = next_opening").select(F.col("conv_id").alias("chosen"), "rejected")


def preference_segments(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """chosen, rejected, part (prompt, chosen or rejected), turn, place, role, text (rendered), loss.

    Turns are matched by turn number; of turns that share one, by role and text
    order.  The prefix ends before the first turn that the two don't share.
    Conversations that are equal have a prompt only.  Null turn numbers come
    first, null roles and texts count as empty, rows without a conversation
    and pairs with an unknown or null side add nothing of that side.  A pair
    that comes twice comes out twice; no pairs or no turns, no rows.
    """
    return _segments(stored(_turns(conversations), "turns"), pairs)


def _segments(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    turns = turns.withColumn("turn_order", F.coalesce("turn", F.lit(-(1 << 62))))
    pairs = pairs.select("chosen", "rejected").distinct()
    sided = pairs.select("*", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("conv_id")) for s in ("chosen", "rejected")])).alias("s")).select("chosen", "rejected", "s.*")
    # the prefix is found on hashes; texts move once, to the pairs whose ends are known
    heads = turns.select("conv_id", "turn_order", "place", F.xxhash64("role", "text").alias("h1"), F.crc32(F.concat_ws("\n", "role", "text").cast("binary")).alias("h2"))
    at = heads.join(sided, "conv_id").groupBy("chosen", "rejected", "turn_order", "place")
    at = at.agg(F.count("*").alias("n"), F.min("h1").alias("a1"), F.max("h1").alias("b1"), F.min("h2").alias("a2"), F.max("h2").alias("b2"))
    ends = at.where("n < 2 OR a1 <> b1 OR a2 <> b2").groupBy("chosen", "rejected").agg(F.min(F.struct("turn_order", "place")).alias("end"))
    ended = sided.join(ends, ["chosen", "rejected"], "left")
    rows = turns.join(ended, "conv_id")
    before = F.col("end").isNull() | (F.struct("turn_order", "place") < F.col("end"))
    rows = rows.withColumn("part", F.when(before, F.lit("prompt")).otherwise(F.col("side"))).where("part <> 'prompt' OR side = 'chosen'")
    loss = (F.col("part") != "prompt") & (F.col("role") == ANSWERING)
    return rows.select("chosen", "rejected", "part", "turn", "place", "role", rendered(F.col("role"), F.col("text")).alias("text"), loss.alias("loss"))


def borrowed_answers(conversations: DataFrame) -> DataFrame:
    """Rejected conversations for those without any: conv_id, turn, role, text.

    A conversation's last answer, and what follows it, gives way to the last
    answer of the next conversation by id; the id becomes -1 - conv_id, which
    real ids (0 and up) don't use.  The last conversation that has an answer,
    and those without one, get no counterpart.
    """
    return _borrowed(_turns(conversations))


def _borrowed(turns: DataFrame) -> DataFrame:
    turns = turns.withColumn("turn_order", F.coalesce("turn", F.lit(-(1 << 62))))
    last = turns.where(F.col("role") == ANSWERING).groupBy("conv_id").agg(F.max(F.struct("turn_order", "place", "turn", "text")).alias("last"))
    last = numbered(last, ["conv_id"])
    other = last.select((F.col("row_number") - 1).alias("row_number"), F.col("last.text").alias("text"))
    answers = last.join(other, "row_number").select((-1 - F.col("conv_id")).alias("conv_id"), F.col("last.turn").alias("turn"), F.lit(ANSWERING).alias("role"), "text", F.struct("last.turn_order", "last.place").alias("end"))
    before = turns.withColumn("conv_id", -1 - F.col("conv_id")).join(answers.select("conv_id", "end"), "conv_id").where(F.struct("turn_order", "place") < F.col("end"))
    return answers.drop("end").unionByName(before.select("conv_id", "turn", "role", "text"))


def op5_preference_format(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = stored(_turns(conversations), "turns")
    borrowed = stored(_turns(_borrowed(turns)), "borrowed")
    opposed = borrowed.select((-1 - F.col("conv_id")).alias("chosen"), F.col("conv_id").alias("rejected")).distinct()
    return _segments(turns.unionByName(borrowed), _neighbours(turns).unionByName(opposed))


OP5_SQL = r"""
WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, turn, place, lead(text) OVER (ORDER BY conv_id) AS answer FROM (SELECT * FROM t0 WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, place DESC) = 1) QUALIFY answer IS NOT NULL),
raw AS (SELECT conv_id, turn, role, text FROM t0 UNION ALL SELECT -1 - conv_id, turn, 'assistant', answer FROM l
  UNION ALL SELECT -1 - t0.conv_id, t0.turn, t0.role, t0.text FROM t0 JOIN l USING (conv_id) WHERE (t0.turn, t0.place) < (l.turn, l.place)),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS place FROM raw),
o AS (SELECT conv_id, role, text FROM t0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, place) = 1),
p AS (SELECT conv_id AS chosen, lead(conv_id) OVER (PARTITION BY role, text ORDER BY conv_id) AS rejected FROM o QUALIFY rejected IS NOT NULL UNION ALL SELECT conv_id, -1 - conv_id FROM l),
s AS (SELECT p.*, 'chosen' AS side, t.* FROM p JOIN t ON t.conv_id = chosen UNION ALL SELECT p.*, 'rejected', t.* FROM p JOIN t ON t.conv_id = rejected),
m AS (SELECT s.*, x.conv_id IS NOT NULL AS same FROM s LEFT JOIN t x ON x.conv_id = CASE side WHEN 'chosen' THEN rejected ELSE chosen END AND x.turn = s.turn AND x.place = s.place AND x.role = s.role AND x.text = s.text),
f AS (SELECT chosen, rejected, min((turn, place)) FILTER (NOT same) AS e FROM m GROUP BY chosen, rejected),
r AS (SELECT s.*, CASE WHEN e IS NULL OR (s.turn, s.place) < e THEN 'prompt' ELSE side END AS part FROM s JOIN f USING (chosen, rejected))
SELECT chosen, rejected, part, turn, place::INTEGER AS place, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS text, part <> 'prompt' AND role = 'assistant' AS loss
FROM r WHERE part <> 'prompt' OR side = 'chosen'
"""
