"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For every participant the dialogue is rendered once with that speaker as the
assistant and all others as named users; the mask marks what the speaker says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddystream.llm.common import plain

#: Turn numbers that are rendered together, a step before whole views.
BLOCK_TURNS = 64
SYSTEM = "system"
NOBODY = "unknown"


def _blocks(turns: DataFrame, block: Column, system: str) -> DataFrame:
    """(conv_id, participant, block, n_turns, n_own, text, mask): the views of each ``block`` of a dialogue by itself."""
    rows = plain(turns, "conv_id", "turn", "role", "text").select(
        "conv_id",
        block.cast("long").alias("block"),
        F.struct("turn", F.coalesce("role", F.lit(NOBODY)).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("said")).alias("all"))
    people = rows.select(F.col("conv_id").alias("conv"), F.col("said.role").alias("participant")).where(F.col("participant") != system).distinct()
    views = blocks.join(people, F.col("conv_id").eqNullSafe(F.col("conv")))
    own = lambda t: t["role"] == F.col("participant")
    head = lambda t: F.when(own(t), F.lit("<|assistant|>\n")).when(t["role"] == system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n")))
    parts = F.transform("all", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit("<|end|>\n")).alias("body"), own(t).alias("own")))
    views = views.select("conv_id", "participant", "block", parts.alias("parts"))
    starts = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("mask")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(p["own"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("length"))))).otherwise(acc["mask"]).alias("mask"),
        ),
    )
    return views.select(
        "conv_id", "participant", "block",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        starts["mask"].alias("mask"),
    )


def perspectives(turns: DataFrame, block_turns: int = BLOCK_TURNS, system: str = SYSTEM) -> DataFrame:
    """(conv_id, participant, n_turns, n_own, text, mask) for ``turns`` (conv_id, turn, role, text): one view of the whole dialogue a participant.

    Participants are the distinct roles of a conversation but ``system``, which
    keeps its own name in every view; a conversation without any participant
    has no views. Turns go by (turn, role, text), null turns first; repeated
    rows stay. A null role is "unknown", a null text empty; all rows with a
    null conv_id are one conversation. ``mask`` has (start, length) of each
    stretch that the participant says, end mark included, counted in characters
    of ``text`` from 0. A dialogue is rendered in blocks of ``block_turns`` turn
    numbers, in as many tasks, which are then joined in order with their masks
    moved on; the block's size doesn't show in the result. A view is one row,
    so its text has to fit into one (2 GB). An empty table gives no rows.
    """
    blocks = _blocks(turns, F.floor(F.col("turn") / block_turns), system)
    before = Window.partitionBy("conv_id", "participant").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("at", F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0)))
    moved = F.transform("mask", lambda m: F.struct((m["start"] + F.col("at")).alias("start"), m["length"].alias("length")))
    placed = placed.select("conv_id", "participant", "n_turns", "n_own", F.struct("at", "text", moved.alias("mask")).alias("piece"))
    whole = placed.groupBy("conv_id", "participant").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_own").alias("n_own"), F.sort_array(F.collect_list("piece")).alias("pieces"))
    return whole.select("conv_id", "participant", "n_turns", "n_own", F.array_join("pieces.text", "").alias("text"), F.flatten("pieces.mask").alias("mask"))


def op4_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    """Every view; the mask as a string of start+length pairs, which compares alike everywhere."""
    out = perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws("+", m["start"].cast("string"), m["length"].cast("string"))), ","))


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'
), parts AS (
  SELECT t.conv_id, p.participant, t.turn, t.role, t.text, t.role = p.participant AS own,
         CASE WHEN t.role = p.participant THEN '<|assistant|>' || chr(10)
              WHEN t.role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || t.role || '|>' || chr(10) END AS head,
         t.text || '<|end|>' || chr(10) AS body
  FROM t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, row_number() OVER w AS i, sum(length(head) + length(body)) OVER w - length(body) AS start
  FROM parts WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, participant, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || body, '' ORDER BY i) AS text,
       coalesce(string_agg(CAST(start AS BIGINT) || '+' || length(body), ',' ORDER BY i) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, participant
"""
