"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation again and again, as it stood after each turn. Every turn gets a hash of all turns
up to it, rolled on from that of the turn before. A conversation whose last hash is an earlier turn's hash of another
is a prefix of that one; anti-joins on these hashes leave the maximal conversations, which alone are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, small_side

START, END = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    c = lambda name: F.col(f"`{name}`")
    src = conversations.select(c(conv_col).alias("conv"), c(turn_col).cast("long").alias("turn"), F.coalesce(c(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(c(text_col).cast("string"), F.lit("")).alias("text"))
    return src.where("conv is not null")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv, k, p1, p2, last): for each turn its number, a 128-bit hash of all turns up to it, and whether it is the last.

    Only hashes of turns are moved and sorted. Texts come along where they decide an order: in conversations that have
    different texts of one turn and role.
    """
    h = [F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(7919), "role").alias("h2")]
    keys = cut(turns.select("conv", "turn", "role", *h).distinct())
    torn = cut(keys.groupBy("conv", "turn", "role").agg(F.count("*").alias("n")).where("n > 1").select("conv").distinct())
    rows = keys.withColumn("o", F.lit(None).cast("string"))
    if not torn.isEmpty():
        few = small_side(torn)
        rows = rows.join(few, "conv", "left_anti").unionByName(turns.join(few, "conv", "left_semi").select("conv", "turn", "role", *h, F.col("text").alias("o")).distinct())
    by = Window.partitionBy("conv").orderBy("turn", "role", "o")
    # What a turn adds to the hash depends on its number, so the order of turns counts though xor has none.
    numbered = rows.withColumn("k", F.row_number().over(by)).withColumn("last", F.lead("role").over(by).isNull())
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p1, p2 = F.bit_xor(F.xxhash64("h1", "h2", "k")).over(so_far), F.bit_xor(F.xxhash64("k", "h2", "h1")).over(so_far)
    out = cut(numbered.select("conv", "k", p1.alias("p1"), p2.alias("p2"), "last"))
    release(keys, torn)
    return out


def maximal_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, rendered): the conversations that are a prefix of no other, rendered for training.

    Turns are ordered by turn, then role, then text, so ties have an order; a null turn comes first. Rows repeated
    whole count once. A null role is 'unknown' and a null text is empty. Turns of a null conversation are left out,
    as they belong to none. Of conversations that are equal, the one with the lowest id stays. Texts may be of any
    length, and conversations have any number of turns; what is rendered is one string, which Spark bounds by 2 GB. An
    empty table gives no rows. Other columns aren't read.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    hashed = prefix_hashes(turns)
    # Equal conversations become one before the hashes meet.
    full = hashed.where("last").groupBy("p1", "p2").agg(F.min("conv").alias("conv"), F.first("k").alias("n"))
    shorter = hashed.where("not last").select("p1", "p2").distinct()
    kept = small_side(cut(full.join(shorter, ["p1", "p2"], "left_anti").select("conv", "n")))
    # Texts are moved once, those of what is left; the set of a conversation's rows has each of them once.
    spoken = turns.join(kept, "conv")
    rows = spoken.groupBy("conv", "n").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("s"))
    say = lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["text"], F.lit(END + "\n"))
    return rows.select(F.col("conv").alias("conv_id"), F.col("n").cast("int").alias("n_turns"), F.array_join(F.transform("s", say), "").alias("rendered"))
