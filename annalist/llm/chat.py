"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The prompt is the longest common prefix of turns: all turns before the first turn number at which
the two conversations differ. It is rendered once; what follows is rendered for each side, with
the spans of characters that a loss may use (what the assistant says, and its end mark). Only
DataFrame functions are used. Rows are first merged by (pair, turn, role, text), which adds up
repeated rows before anything is gathered. A pair is one row, however many turns it has; Spark's
bound of 2 GB for a string holds. ``parts`` gives the same examples as a table of pieces of ``PART``
turn numbers, for conversations beyond that bound: joined by pair_id and concatenated in order of
part, the pieces are the whole texts.

Defined cases: a missing side leaves an empty prompt and an empty completion, and ``paired`` false;
equal conversations are all prompt; repeated rows count once; several rows of one turn are ordered
by role and text and differ if their sets differ; a null turn comes before all others, a null role
is a user, a null text is empty; rows without a conversation belong to no pair; control marks in
texts are broken up; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turn numbers of one row of ``parts``.
PART = 256


def sided(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, side, turn, role, text) for explicit ``pairs`` (pair_id, chosen_id, rejected_id)."""
    ids = pairs.select("pair_id", F.explode(F.array(*(F.struct(F.col(c).alias("conv_id"), F.lit(side).alias("side")) for side, c in enumerate(("chosen_id", "rejected_id"))))).alias("e"))
    return turns.join(ids.select("pair_id", "e.*"), "conv_id").select("pair_id", "side", "turn", "role", "text")


def neighbours(turns: DataFrame) -> DataFrame:
    """(pair_id, side, turn, role, text): conversation 2 k is chosen over 2 k + 1."""
    known = turns.filter("conv_id is not null")
    return known.select(F.shiftright("conv_id", 1).alias("pair_id"), F.col("conv_id").bitwiseAND(1).cast("int").alias("side"), "turn", "role", "text")


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"), turn["text"], F.lit(END))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column) -> Column:
    """[start, end) of what the assistant says, with its end mark, in the rendered text."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        end = done["at"] + F.char_length(_rendered(turn))
        start = done["at"] + F.lit(len(START) + 1) + F.char_length(turn["role"])
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", F.concat(done["spans"], own)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step, lambda done: done["spans"])


def formatted(sides: DataFrame) -> DataFrame:
    """One row for each pair: (pair_id, paired, prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans).

    ``prompt_turns`` counts the prompt's rows. ``sides`` is as ``sided`` gives it.
    """
    return _rows(sides, F.lit(0).cast("long")).drop("part")


def parts(sides: DataFrame, size: int = PART) -> DataFrame:
    """The columns of ``formatted`` and ``part``: a row for every ``size`` turn numbers of a pair; counts and spans are the part's own."""
    return _rows(sides, F.floor(F.col("turn") / size).cast("long"))


def _rows(sides: DataFrame, part: Column) -> DataFrame:
    clean = sides.select(
        "pair_id",
        "side",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    merged = clean.groupBy("pair_id", "turn", "role", "text").agg(F.max(F.col("side") == 0).alias("c"), F.max(F.col("side") == 1).alias("r"))
    heads = merged.groupBy("pair_id").agg(
        F.min(F.when(~(F.col("c") & F.col("r")), F.col("turn"))).alias("split"), (F.max("c") & F.max("r")).alias("paired")
    )
    common = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    turns = (
        merged.join(heads, "pair_id")
        .withColumn("part", part)
        .groupBy("pair_id", "part", "paired")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", common.alias("p"), "c", "r"))).alias("turns"))
    )
    own = {
        "prompt": F.filter("turns", lambda t: t["p"]),
        "chosen": F.filter("turns", lambda t: ~t["p"] & t["c"]),
        "rejected": F.filter("turns", lambda t: ~t["p"] & t["r"]),
    }
    split = turns.select("pair_id", "part", "paired", *(x.alias(name) for name, x in own.items()))
    return split.select(
        "pair_id",
        "part",
        "paired",
        F.size("prompt").cast("long").alias("prompt_turns"),
        _text(F.col("prompt")).alias("prompt"),
        _text(F.col("chosen")).alias("chosen"),
        _spans(F.col("chosen")).alias("chosen_spans"),
        _text(F.col("rejected")).alias("rejected"),
        _spans(F.col("rejected")).alias("rejected_spans"),
    )


def _written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted in pairs; spans are written as start:end,start:end."""
    made = formatted(neighbours(table(spark, sf_dir, "conversations")))
    return made.withColumns({c: _written(c) for c in ("chosen_spans", "rejected_spans")})


QUERIES = {"op7_preference_chat": query}
ORACLE_SQL = {
    "op7_preference_chat": """
with t as (
  select conv_id >> 1 as pair_id, conv_id & 1 as side, coalesce(turn, -1) as turn, coalesce(role, 'user') as role,
         replace(coalesce(text, ''), '<|', '< |') as text
  from conversations where conv_id is not null),
m as (select pair_id, turn, role, text, bool_or(side = 0) as c, bool_or(side = 1) as r from t group by all),
h as (select pair_id, min(case when not (c and r) then turn end) as split, bool_or(c) and bool_or(r) as paired from m group by all),
x as (
  select m.*, paired, split is null or turn < split as p,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as line
  from m join h using (pair_id)),
s as (
  select *, sum(length(line)) filter (where not p and c) over w as c_end, sum(length(line)) filter (where not p and r) over w as r_end
  from x window w as (partition by pair_id order by turn, role, text rows unbounded preceding))
select pair_id, paired, count(*) filter (where p) as prompt_turns,
       coalesce(string_agg(line, '' order by turn, role, text) filter (where p), '') as prompt,
       coalesce(string_agg(line, '' order by turn, role, text) filter (where not p and c), '') as chosen,
       coalesce(string_agg((c_end - length(line) + 13 + length(role)) || ':' || c_end, ',' order by turn, role, text) filter (where not p and c and role = 'assistant'), '') as chosen_spans,
       coalesce(string_agg(line, '' order by turn, role, text) filter (where not p and r), '') as rejected,
       coalesce(string_agg((r_end - length(line) + 13 + length(role)) || ':' || r_end, ',' order by turn, role, text) filter (where not p and r and role = 'assistant'), '') as rejected_spans
from s group by pair_id, paired"""
}
