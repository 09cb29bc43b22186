"""Preference formatting: one prompt from the turns two conversations share, and a masked completion of each.

Rows are turns until a pair is put together, and then a row holds PART_TURNS turns
of each side at most, so a conversation's length is not bounded by a task's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import lookup

#: Turn numbers of a conversation that one row of a pair holds.
PART_TURNS = 256


def preference_format(turns: DataFrame, total: int, pair: str = "pair_id", side: str = "side") -> DataFrame:
    """Turns of pairs -> rendered segments.

    ``turns`` has the pair, the side ('chosen' or 'rejected'), conv_id, turn, role and
    text.  The longest common turn prefix ends before the first turn number at which
    the two sides' rows (role and text, as a multiset where a number repeats) differ.
    Its turns come once, as segment 'prompt'; the others as 'chosen' and 'rejected'.
    ``loss_from`` and ``loss_to`` are the code points of ``rendered`` to train on:
    an assistant turn's text and end mark in a completion, else an empty span.

    Null pairs are left out; a null turn number stands before all others, a null
    role is 'unknown', null text is empty.  A side that is missing altogether
    shares no turn.  Columns other than those named are dropped.
    """
    at, who = F.coalesce(F.col("turn"), F.lit(-1)).cast("long"), F.coalesce(F.lower("role"), F.lit("unknown"))
    rows = turns.filter(F.col(pair).isNotNull()).select(F.col(pair).alias("pair_id"), F.col(side).alias("side"), "conv_id", at.alias("turn"), who.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", "role", "text"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    sign = F.when(F.col("side") == "chosen", F.lit(1)).otherwise(F.lit(-1))
    at_turn = rows.groupBy("pair_id", "turn").agg(F.sum(sign).alias("d_count"), F.sum(digest * sign).alias("d_hash"), F.count(F.lit(1)).alias("n"))
    differs = (F.col("d_count") != 0) | (F.col("d_hash") != 0)
    forks = at_turn.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("fork"), F.sum("n").alias("n_rows"))
    found = lookup(rows, forks.withColumn("known", F.lit(True)), "pair_id", "n_rows", total, "turn")
    shared = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    found = found.filter(~shared | (F.col("side") == "chosen")).withColumn("segment", F.when(shared, F.lit("prompt")).otherwise(F.col("side")))
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    train = (F.col("segment") != "prompt") & (F.col("role") == "assistant")
    rendered = F.concat(head, F.col("text"), F.lit("<|end|>\n"))
    end = F.char_length(rendered).cast("long")
    return found.select("pair_id", "segment", "conv_id", "turn", "role", rendered.alias("rendered"), F.when(train, F.char_length(head).cast("long")).otherwise(end).alias("loss_from"), end.alias("loss_to"))


def paired(segments: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Segments -> pairs: pair_id, part, prompt, chosen, rejected, chosen_spans, rejected_spans.

    Each text is its turns one after the other, so the prompt stands once for both
    completions; spans (from, to) are the code points of a row's completion to train
    on.  A pair is one row, part 0; one with turn numbers of ``part_turns`` or more goes on in
    parts 1, 2, ..., whose texts follow those before.  A side without turns of its
    own is empty.
    """
    turn = F.struct("turn", "conv_id", "rendered", "loss_from", "loss_to")
    sides = ("prompt", "chosen", "rejected")
    part = F.greatest(F.floor(F.col("turn") / part_turns), F.lit(0)).cast("long").alias("part")
    rows = segments.groupBy("pair_id", part).agg(*[F.array_sort(F.collect_list(F.when(F.col("segment") == s, turn))).alias(s) for s in sides])
    start = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<from:bigint,to:bigint>>))")

    def step(state, x):
        span = F.struct((state["at"] + x["loss_from"]).alias("from"), (state["at"] + x["loss_to"]).alias("to"))
        spans = F.when(x["loss_from"] < x["loss_to"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + F.char_length(x["rendered"])).alias("at"), spans.alias("spans"))

    texts = [F.array_join(F.transform(s, lambda x: x["rendered"]), "").alias(s) for s in sides]
    spans = [F.aggregate(s, start, step)["spans"].alias(f"{s}_spans") for s in sides[1:]]
    return rows.select("pair_id", "part", *texts, *spans)
