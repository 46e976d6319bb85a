"""Preference formatting of conversations.

A chosen and a rejected conversation share turns from their first on.  The
longest common prefix is rendered once, as the prompt; what remains of each is
its completion.  A completion's mask lists the spans of code points that a loss
counts: the assistant's texts with their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .shared import materialise

#: The marks around a turn.
START, END = "<|im_start|>", "<|im_end|>\n"


def gather_turns(conversations: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turns array<struct<role, text>>)`` in order of turn, role and text.

    Null turns come first; null roles and texts count as empty.  A conversation
    is rendered as one text, so its turns are gathered in one row.
    """
    item = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(item)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return conversations.groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(turns.alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """``start:end`` of the assistant's texts and end marks, comma-joined."""
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + len(START) + 1 + len(END)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        stop = acc["at"] + size(t)
        start = stop - F.length(t["text"]) - len(END)
        span = F.concat(start.cast("string"), F.lit(":"), (stop - 1).cast("string"))
        return F.struct(stop.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, zero, add, lambda a: a["spans"]), ",")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs(chosen_id, chosen_turns, rejected_id, rejected_turns)`` -> paired completions.

    Gives ``chosen_id, rejected_id, n_prompt_turns, prompt, chosen, chosen_mask,
    rejected, rejected_mask``.  Without a rejected conversation the prompt is
    all before the last turn and the rejected columns are null.
    """
    a, b = F.col("chosen_turns"), F.col("rejected_turns")
    shorter = F.least(F.size(a), F.size(b))
    differ = F.filter(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda t, i: F.when(t["a"].eqNullSafe(t["b"]), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    common = F.when(b.isNull(), F.greatest(F.size(a) - 1, F.lit(0))).otherwise(F.coalesce(F.array_min(differ), shorter))
    rows = pairs.withColumn("n_prompt_turns", common)
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0)))
    return rows.select(
        "chosen_id",
        "rejected_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        _rendered(F.slice(a, F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        _rendered(rest(a)).alias("chosen"),
        _mask(rest(a)).alias("chosen_mask"),
        _rendered(rest(b)).alias("rejected"),
        _mask(rest(b)).alias("rejected_mask"),
    )


def pair_by_first_turn(gathered: DataFrame) -> DataFrame:
    """Each conversation in one pair with another of the same first turn.

    Within a first turn's group, in the order of the ids' digests, the first
    and second form a pair, the third and fourth, and so on; the one left over
    has no rejected partner.  The conversation with more of the assistant's
    text is chosen; if equal, the smaller id.
    """
    first = F.element_at("turns", 1)
    said = F.aggregate("turns", F.lit(0), lambda n, t: n + F.when(t["role"] == "assistant", F.length(t["text"])).otherwise(0))
    rows = gathered.withColumns({"key": F.md5(F.concat_ws("\n", first["role"], first["text"])), "said": said})
    rows = ranked(rows, F.col("key"), F.md5(F.col("conv_id").cast("string")), [F.col("conv_id")])
    rows = rows.withColumn("pair", F.floor((F.col("rank") - 1) / 2))
    item = F.struct((-F.col("said")).alias("said"), F.col("conv_id"), F.col("turns"))
    both = rows.groupBy("key", "pair").agg(F.array_sort(F.collect_list(item)).alias("both"))  # of two at most
    chosen, rejected = F.element_at("both", 1), F.try_element_at("both", F.lit(2))
    return both.select(chosen["conv_id"].alias("chosen_id"), chosen["turns"].alias("chosen_turns"), rejected["conv_id"].alias("rejected_id"), rejected["turns"].alias("rejected_turns"))


def preference_pairs(conversations: DataFrame, **columns) -> DataFrame:
    """:func:`format_preferences` of the conversations paired by their first turn.

    Rows of a null conversation id form a conversation; repeated rows are
    repeated turns; an empty table gives an empty one.
    """
    return format_preferences(pair_by_first_turn(materialise(gather_turns(conversations, **columns), "turns")))
