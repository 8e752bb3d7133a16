"""Chat formatting of preference pairs.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns is
rendered once as the prompt; what follows is rendered for each side as its completion,
with the spans that a trainer learns from: what assistants say, up to and with the end
mark. All of it is column expressions over one grouping by pair.

Texts can't make marks: in a text, < and | with any number of backslashes between them get
one more, which unescaped() takes away again. In a role, every character but letters,
digits, _ . and - becomes _.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rendering: a turn is <|role|>, a line feed, its text, the end mark, a line feed.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>"


def escaped(text: Column) -> Column:
    """text without any <|."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """What escaped() was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END + "\n"))


def _turns(df: DataFrame, side: str) -> DataFrame:
    return df.select(
        F.col("pair_id").cast("long").alias("pair_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.regexp_replace(F.coalesce(F.col("role").cast("string"), F.lit("unknown")), r"[^\p{L}\p{N}_.-]", "_").alias("role"), escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")).alias(side),
    )


def _render_all(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: rendered(t["role"], t["text"])), "")


def _trained(turns: Column) -> Column:
    """Character spans [start, stop) of the rendered turns that are learnt."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,stop:long>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = F.length(t["role"]) + F.lit(len(OPEN) + len(CLOSE))
        stop = acc["at"] + head + F.length(t["text"]) + F.lit(len(END))
        span = F.array(F.struct((acc["at"] + head).cast("long").alias("start"), stop.cast("long").alias("stop")))
        return F.struct((stop + F.lit(1)).cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """chosen, rejected(pair_id, turn, role, text) ->
    (pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans).

    Turns are ordered by (turn, role, text), so ties and repeated rows have one place
    each; null roles read "unknown", null texts "", null turns come first. Texts and roles are
    escaped, so that none of them can start or end a turn. Rows of null
    pair ids are one pair. A pair with one side has an empty prompt unless it is empty
    itself; equal sides are all prompt, with empty completions. Empty tables give an empty
    one; other columns are ignored. One output row holds one pair, so a task needs memory
    for its largest pair.
    """
    sides = _turns(chosen, "c").unionByName(_turns(rejected, "r"), allowMissingColumns=True)
    pairs = sides.groupBy("pair_id").agg(F.sort_array(F.collect_list("c")).alias("c"), F.sort_array(F.collect_list("r")).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("n", F.when(differs == 0, F.size("c")).otherwise(differs - 1).cast("int"))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    cut = pairs.select("pair_id", F.col("n").cast("long").alias("n_prompt_turns"), F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select("pair_id", "n_prompt_turns", _render_all(F.col("p")).alias("prompt"), _render_all(F.col("c")).alias("chosen"), _render_all(F.col("r")).alias("rejected"), _trained(F.col("c")).alias("chosen_spans"), _trained(F.col("r")).alias("rejected_spans"))


def echo_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs of conversations that come without any: chosen is the conversation,
    rejected says in its last assistant turn what the turn before it said (nothing, if it
    is the first). Conversations without an assistant turn are equal on both sides."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("pair_id").orderBy("turn", "role", "text")
    later = order.rowsBetween(1, Window.unboundedFollowing)
    last = (F.col("role") == "assistant") & (F.coalesce(F.sum(F.when(F.col("role") == "assistant", 1)).over(later), F.lit(0)) == 0)
    echoed = F.when(last, F.coalesce(F.lag("text").over(order), F.lit(""))).otherwise(F.col("text"))
    return turns, turns.select("pair_id", "turn", "role", echoed.alias("text"))
