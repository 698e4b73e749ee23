"""Chat formatting by cumulative-snapshot collapse (native).

Logged conversations often hold every snapshot of a growing dialogue. A rolling hash of each
turn prefix finds conversations that are a proper prefix of a longer one; an anti-join drops
them, and of equal conversations the smallest id stays. What stays is rendered as ChatML.

Turns are dealt by conversation once, for the prefixes and for rendering; between the two only
hashes move. A rendered conversation is one value, so its turns meet in one task.

Defined cases: a null role renders as ``unknown``, a null text as empty, and neither equals an
empty value when prefixes are compared. Turns sort by (turn, role, text), nulls first, so
repeated rows are repeated turns. A turn without ``conv_id`` is a conversation by itself, for no id
ties it to others. Texts and conversations of any length are compared by their hashes and rendered
in whole. An empty table gives an empty result. Columns besides the four read are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import materialize

START, END = "<|im_start|>", "<|im_end|>"
LAST_ID = 2**63 - 1


def by_conversation(turns: DataFrame) -> DataFrame:
    """The four columns and ``talk``, the key of the conversation, never null."""
    own = F.concat(F.lit("n"), F.monotonically_increasing_id().cast("string"))
    talk = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), own)
    return turns.select("conv_id", "turn", "role", "text", talk.alias("talk"))


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """``talk, conv_id, pos, h1, h2, whole`` for each turn: rolling hashes of the prefix that ends there.

    Each turn's hash covers its position, so XOR over the prefix depends on the order; two seeds
    give 128 bits. The running XOR is a streaming window, not a collected list.
    """
    by_turn = Window.partitionBy("talk").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    so_far = by_turn.rowsBetween(Window.unboundedPreceding, 0)
    numbered = turns.withColumns({"pos": F.row_number().over(by_turn), "whole": F.lead(F.lit(1)).over(by_turn).isNull()})
    parts = ("pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    hashes = {name: F.bit_xor(F.xxhash64(F.lit(seed), *parts)).over(so_far) for name, seed in (("h1", 11), ("h2", 97))}
    return numbered.withColumns(hashes).select("talk", "conv_id", "pos", "h1", "h2", "whole")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``talk, conv_id, n_turns, copies`` of the conversations to keep, from ``by_conversation``."""
    prefixes = materialize(turn_prefixes(turns))
    key = ["pos", "h1", "h2"]
    first = F.min_by("talk", F.coalesce("conv_id", F.lit(LAST_ID)))
    kept = prefixes.where("whole").groupBy(*key).agg(first.alias("talk"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    # A first turn that many conversations share is one row for each task before it moves.
    proper = prefixes.where(~F.col("whole")).select(*key).distinct()
    return kept.join(proper, key, "left_anti").select("talk", "conv_id", F.col("pos").alias("n_turns"), "copies")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """Maximal conversations as ``conv_id, n_turns, copies, rendered``."""
    turns = by_conversation(turns)
    keep = maximal_conversations(turns)
    piece = F.concat(F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", piece.alias("piece"))))
    texts = turns.drop("conv_id").join(keep, "talk").groupBy("talk", "conv_id", "n_turns", "copies")
    rendered = texts.agg(F.array_join(F.transform(ordered, lambda t: t["piece"]), "").alias("rendered"))
    return rendered.select("conv_id", "n_turns", "copies", "rendered")
