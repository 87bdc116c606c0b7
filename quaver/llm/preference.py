"""Preference pairs: one prompt, two masked completions.

The turns of a chosen and a rejected conversation are compared in order. Their longest
common prefix (same role, same text) is rendered once as the prompt; what follows in
either is its completion, with the spans that a loss may count: the texts of the
assistant's turns with their end marks.

Turns meet their pairs by an equi join (a conversation in very many pairs is split by
Spark) and go once to the task that holds their pair; offsets are running sums there.
What is gathered in one row is one training example.

Edge cases: a null role counts as "unknown", a null text as empty. Turns are ordered by
number (null first), then role and text; equal turns stay repeated. A very long text or
conversation is rendered whole. Rows without a conversation id, and pairs of which one
side has no turns, give nothing; a pair given twice counts once. Where one conversation
is a prefix of the other, its completion is empty. Empty tables give an empty one. Ids
may be of any type. Extra columns are not read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .rows import ranked

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"
#: Tables of at most this many pairs are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def trained_spans(turns: Column, before: Column) -> Column:
    """[start, end) of the trained parts, in characters of the rendered turns, which begin ``before`` characters into their conversation."""
    own = F.filter(turns, lambda t: t["role"] == TRAINED)
    return F.transform(own, lambda t: F.struct((t["end"] - F.length(t["text"]) - len(CLOSE) - before).cast("int").alias("start"), (t["end"] - before).cast("int").alias("end")))


def _turns(turns: DataFrame, side: Column, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    said = (F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).alias("conv"), *said, side.alias("only"))


def format_pairs(
    turns: DataFrame,
    pairs: DataFrame,
    chosen: str = "chosen_id",
    rejected: str = "rejected_id",
    rejected_turns: DataFrame | None = None,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(chosen_id, rejected_id, n_common, prompt, chosen, chosen_spans, rejected, rejected_spans) for each pair of ``pairs``.

    ``rejected_turns``: the table of the rejected conversations, if they are not in ``turns``.
    """
    names = (conv_id, turn, role, text)
    if rejected_turns is None:
        said = _turns(turns, F.lit(None).cast("int"), *names)
    else:
        said = _turns(turns, F.lit(0), *names).unionByName(_turns(rejected_turns, F.lit(1), *names))
    ids = pairs.select(F.col(chosen).alias("chosen_id"), F.col(rejected).alias("rejected_id")).distinct()
    sides = F.array(F.struct(F.col("chosen_id").alias("id"), F.lit(0).alias("side")), F.struct(F.col("rejected_id").alias("id"), F.lit(1).alias("side")))
    sides = ids.withColumn("s", F.explode(sides)).select("chosen_id", "rejected_id", "s.id", "s.side")
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sides = F.broadcast(sides)
    met = said.join(sides, (F.col("conv") == F.col("id")) & F.coalesce(F.col("only") == F.col("side"), F.lit(True)))
    met = met.repartition("chosen_id", "rejected_id")
    along = W.Window.partitionBy("chosen_id", "rejected_id", "side").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    size = F.length("role") + F.length("text") + len(OPEN + MIDDLE + CLOSE)
    met = met.withColumn("end", F.sum(size).over(along))
    one = F.struct("turn", "role", "text", "end")
    side = lambda i: F.sort_array(F.collect_list(F.when(F.col("side") == i, one)))
    both = met.groupBy("chosen_id", "rejected_id").agg(side(0).alias("a"), side(1).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    same = F.zip_with("a", "b", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    both = both.withColumn("n_common", (F.array_position(F.array_append(same, F.lit(False)), F.lit(False)) - 1).cast("int"))
    tail = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    both = both.withColumns({"p": F.slice("a", F.lit(1), F.col("n_common")), "c": tail(F.col("a")), "r": tail(F.col("b"))})
    shared = F.coalesce(F.get("a", F.col("n_common") - 1)["end"], F.lit(0))
    return both.select(
        "chosen_id", "rejected_id", "n_common", render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"), trained_spans(F.col("c"), shared).alias("chosen_spans"),
        render(F.col("r")).alias("rejected"), trained_spans(F.col("r"), shared).alias("rejected_spans"),
    )


def other_replies(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rejected conversations for a table that has none, under the same ids.

    Each conversation up to its last assistant turn, whose text is that of the next conversation in the order of ids
    that has such a turn (the last takes the first's). Ids are ordered as their type is, however far apart they stand.
    Conversations without such a turn give none, and so do those whose next one replies the same, as they would have
    nothing to prefer: a table of one conversation gives none.
    """
    said = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    own = F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))
    last = said.where((F.col("role") == TRAINED) & F.col("turn").isNotNull()).groupBy("conv_id").agg(F.max(own).alias("last"))
    last = ranked(last.select("conv_id", F.col("last.turn").alias("at"), F.col("last.text").alias("own")), "conv_id", "replies")
    n = last.agg(F.max("rank") + 1).first()[0] or 1
    following = last.select(F.pmod(F.col("rank") - 1, F.lit(n)).alias("rank"), F.col("own").alias("reply"))
    reply = last.join(following, "rank").where(F.col("reply") != F.col("own")).select("conv_id", "at", "reply")
    swapped = F.when((F.col("turn") == F.col("at")) & (F.col("role") == TRAINED), F.col("reply")).otherwise(F.col("text"))
    return said.join(reply, "conv_id").where("turn is null or turn <= at").select("conv_id", "turn", "role", swapped.alias("text"))
