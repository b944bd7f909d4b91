"""Chat formatting of logged conversations, without the snapshots that longer logs contain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtally.llm.tables import table
from voxtally.session import materialize

BLOCK = 64  # turn numbers that one window numbers together

_LOW = 0xFFFFFFFF
_LAST = (1 << 63) - 1


def place_turns(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """``(conv_id, at, role, text)``: turns numbered from 1 in each conversation.

    Order is by turn number, role and text; a null turn number comes last. Null roles and texts are
    empty, a null conversation is one conversation, and rows that repeat a whole turn count once.
    Numbers are given within blocks of turn numbers, plus the size of the blocks before, so that a
    conversation with a large share of all turns is dealt out over many tasks.
    """
    rows = turns.select(
        F.struct(F.col(conversation).alias("conv_id")).alias("conv"),
        # Turns without a number form the last block.
        F.coalesce(F.floor(F.col(turn) / block), F.lit(_LAST)).alias("block"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    # Dealt out once by conversation and block, which the steps below all go by.
    rows = rows.repartition("conv", "block").dropDuplicates()
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        turns.select(
            F.struct(F.col(conversation).alias("conv_id")).alias("conv"),
            F.coalesce(F.floor(F.col(turn) / block), F.lit(_LAST)).alias("block"),
            F.xxhash64(
                F.col(turn).isNull(), F.col(turn), F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
            ).alias("row"),
        )
        .distinct()
        .groupBy("conv", "block")
        .agg(F.count("*").alias("n"))
        .select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    return (
        rows.withColumn("row", F.row_number().over(inside))
        .join(starts, ["conv", "block"])
        .select("conv.conv_id", (F.col("row") + F.col("start")).alias("at"), "role", "text")
    )


def _limbs(at: str | Column) -> list[Column]:
    """A turn's 128-bit hash in four parts of 32 bits, which sums cannot overflow."""
    hashes = [F.xxhash64(F.lit(seed), at, "role", "text") for seed in (1, 2)]
    return [
        part.alias(f"h{i}")
        for i, part in enumerate(
            x for h in hashes for x in (h.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h, 32))
        )
    ]


def prefix_hashes(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv_id, at, hash)``: the rolling hash of each conversation's first ``at`` turns.

    Turns hash with their place, and a prefix is the sum of its turns' hashes, so sums of blocks
    combine: the running sum within a block plus the totals of the blocks before it.
    """
    parts = [f"h{i}" for i in range(4)]
    rows = placed.select(
        "conv_id", "at", F.floor((F.col("at") - 1) / block).alias("block"), *_limbs("at")
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("at")
    before = (
        Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        rows.groupBy("conv_id", "block")
        .agg(*(F.sum(h).alias(h) for h in parts))
        .select(
            "conv_id", "block", *(F.coalesce(F.sum(h).over(before), F.lit(0)).alias(f"_{h}") for h in parts)
        )
    )
    running = rows.select("conv_id", "at", "block", *(F.sum(h).over(inside).alias(h) for h in parts))
    sums = [(F.col(f"r.{h}") + F.col(f"t._{h}")).cast("string") for h in parts]
    return running.alias("r").join(
        totals.alias("t"),
        F.col("r.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("r.block") == F.col("t.block")),
    ).select("r.conv_id", "at", F.md5(F.concat_ws(",", *sums)).alias("hash"))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies)`` of the conversations that no longer one begins with.

    Of equal conversations the one with the lowest id stays; a null id is lower than any other.
    """
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("at", "hash"), "at").alias("last"))
    whole = last.groupBy("last.hash", "last.at").agg(
        F.min(F.struct(F.col("conv_id").isNotNull().alias("named"), "conv_id")).alias("first"),
        F.count("*").alias("n_copies"),
    )
    ends = last.select("conv_id", F.col("last.at").alias("n"))
    inner = (
        prefixes.alias("p")
        .join(ends.alias("e"), F.col("p.conv_id").eqNullSafe(F.col("e.conv_id")))
        .where("at < n")
        .select("hash", "at")
        .distinct()
    )
    return whole.join(inner, ["hash", "at"], "left_anti").select(
        F.col("first.conv_id").alias("conv_id"), F.col("at").alias("n_turns"), "n_copies"
    )


def format_chats(turns: DataFrame, **columns: str) -> DataFrame:
    """``(conv_id, n_turns, n_copies, chat)``: one rendered text per maximal conversation.

    A conversation that is the beginning of a longer logged one is dropped; equal conversations
    give one row. A turn is rendered as ``<|role|>``, a line break, its text, ``<|end|>`` and a line
    break. See :func:`place_turns` for nulls and repeated rows; no turns give no rows.
    """
    placed = materialize(place_turns(turns, **columns), "turns")
    kept = maximal_conversations(materialize(prefix_hashes(placed), "prefixes"))
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    return (
        placed.alias("p")
        .join(kept.alias("k"), F.col("p.conv_id").eqNullSafe(F.col("k.conv_id")))
        .groupBy("p.conv_id")
        .agg(
            F.first("n_turns").alias("n_turns"),
            F.first("n_copies").alias("n_copies"),
            F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("lines"),
        )
        .select(
            "conv_id",
            "n_turns",
            "n_copies",
            F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("chat"),
        )
    )


def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return format_chats(table(spark, folder, "conversations"))


OP1_SQL = r"""
WITH turns AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
),
whole AS (
    SELECT conv_id, count(*) AS n_turns,
           list('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)
                ORDER BY turn NULLS LAST, role, text) AS lines
    FROM turns GROUP BY conv_id
),
firsts AS (
    SELECT lines, any_value(n_turns) AS n_turns,
           CASE WHEN bool_or(conv_id IS NULL) THEN NULL ELSE min(conv_id) END AS conv_id,
           count(*) AS n_copies
    FROM whole GROUP BY lines
),
prefixes AS (
    SELECT DISTINCT lines[1:k] AS lines
    FROM whole, LATERAL (SELECT unnest(range(1, n_turns)) AS k)
)
SELECT conv_id, n_turns, n_copies, array_to_string(lines, '') AS chat
FROM firsts WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.lines = firsts.lines)
"""
