"""Preference formatting: one prompt and two masked completions per pair.

The longest common turn prefix of a chosen and a rejected conversation is rendered once
as the prompt.  What follows in each is its completion, and its mask lists the
character spans to train on: what an assistant says, with the end mark.

A conversation is one row, since its rendering is one string.

Nulls, ties and the like
    Turns are ordered by turn, role and text, nulls first, so repeated turns are kept
    and gaps do not matter.  Null roles and texts render as empty strings; a null
    equals a null in the prefix.  Rows without a pair id belong to no conversation.
    A pair that lacks a side is left out.  If one side is the prefix of the other its
    completion is empty and has no spans; equal sides have two empty completions.
    An empty table gives an empty result.  Further columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photocat.llm.common import Scratch, numbered

# Fixed values of the template.
OPEN, CLOSE, END = "<|im_start|>", "<|im_end|>", "\n"


def _rendered(turn: Column) -> Column:
    return F.concat(_head(turn), _said(turn), F.lit(END))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def _said(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def _spans(turns: Column, role: str) -> Column:
    """Character spans, end exclusive, of what ``role`` says in the rendered turns."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc, turn):
        begin = acc["at"] + F.length(_head(turn))
        end = begin + F.length(_said(turn))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(
            (end + len(END)).alias("at"),
            F.when(turn["role"] == role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(turns, start, step)["spans"]


def conversations(turns: DataFrame, key: str) -> DataFrame:
    """``(key, turns)``: the ordered turns of each conversation."""
    return (
        turns.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )


def format_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id", trained: str = "assistant") -> DataFrame:
    """``chosen`` and ``rejected`` are ``(key, turn, role, text)``; one row per key on both sides."""
    left = conversations(chosen, key).withColumnRenamed("turns", "_chosen")
    right = conversations(rejected, key).withColumnRenamed("turns", "_rejected")
    return _formatted(left.join(right, key), key, trained)


def _formatted(pairs, key, trained) -> DataFrame:
    equal = F.zip_with(
        "_chosen", "_rejected", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])
        & a["turn"].isNotNull().eqNullSafe(b["turn"].isNotNull())
    )
    shorter = F.least(F.size("_chosen"), F.size("_rejected"))
    first = F.array_position(equal, False).cast("int") - 1
    common = F.when(first < 0, shorter).otherwise(F.least(first, shorter))
    parted = pairs.withColumn("n_common", common).select(
        key,
        "n_common",
        F.slice("_chosen", 1, F.col("n_common")).alias("_prompt"),
        *[
            F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0))).alias(c)
            for c in ("_chosen", "_rejected")
        ],
    )
    text = lambda c: F.array_join(F.transform(c, _rendered), "")
    return parted.select(
        key,
        "n_common",
        text("_prompt").alias("prompt"),
        text("_chosen").alias("chosen"),
        _spans(F.col("_chosen"), trained).alias("chosen_spans"),
        text("_rejected").alias("rejected"),
        _spans(F.col("_rejected"), trained).alias("rejected_spans"),
    )


def pairs_from_neighbours(turns: DataFrame, key: str = "conv_id", trained: str = "assistant") -> DataFrame:
    """Preference pairs of a table without preferences.

    Chosen is each conversation up to its last answer; rejected is the same with the
    last answer of the next conversation in the order of ids (the last takes that of
    the first).  Conversations without an answer make no pair.
    """
    scratch = Scratch(turns.sparkSession, "preference")
    whole = conversations(turns, key)
    answers = F.filter("turns", lambda t: t["role"] == trained)
    last = F.size("turns") - F.array_position(
        F.transform(F.reverse("turns"), lambda t: F.coalesce(t["role"] == trained, F.lit(False))), True
    ).cast("int")
    cut = whole.where(F.size(answers) > 0).withColumn("_last", last).select(
        key, F.slice("turns", 1, F.col("_last") + 1).alias("_chosen")
    )
    cut = numbered(cut, [F.col(key).asc()], scratch, "ordered")
    n = F.lit(cut.count())
    following = cut.select(
        F.pmod(F.col("_index") - 1, n).alias("_index"), F.element_at("_chosen", -1)["text"].alias("_other")
    )
    pairs = cut.join(following, "_index").withColumn(
        "_rejected",
        F.concat(
            F.slice("_chosen", 1, F.size("_chosen") - 1),
            F.array(
                F.struct(
                    F.element_at("_chosen", -1)["turn"].alias("turn"),
                    F.element_at("_chosen", -1)["role"].alias("role"),
                    F.col("_other").alias("text"),
                )
            ),
        ),
    )
    return _formatted(pairs, key, trained)
