"""The word index of facts: what a batch looks up instead of reading all facts.

An entry stands under the hash of what it is found by: a word in a family, a word in any workstream,
a family, the file of a note that a fact was learned from, or, for searches, a stem or the first
bytes of one. It names the fact, its file, how many different content words it has and the bytes it
takes.

A search reads the postings of its own terms only. Each term gives a fact one of two fixed amounts,
whatever the fact's length and the term's count in it, so there are no score bounds by block to
prune by: all postings of a term weigh the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text
from annalist.operators.change import FACT_BYTES
from annalist.operators.similarity import PREFERENCES, SHARED

INDEX = "key long, id string, entity_id string, n int, bytes long"
#: The parts of the index: what batches look up, and what searches do, of which only keys and ids are kept.
BATCH, SEARCH = "batch", "search"
#: Versions of a note have ids that begin so and end in a hash after the last colon.
NOTE = "evt_ide_md:"


def word_key(family: Column, word: Column) -> Column:
    return F.xxhash64(F.lit("word"), family, word)


def workstream_key(word: Column) -> Column:
    return F.xxhash64(F.lit("workstream"), word)


def family_key(family: Column) -> Column:
    return F.xxhash64(F.lit("family"), family)


def file_key(event_id: Column) -> Column:
    return F.xxhash64(F.lit("file"), F.regexp_replace(event_id, "[^:]*$", ""))


def stem_key(stem: Column) -> Column:
    return F.xxhash64(F.lit("stem"), stem)


def head_key(head: Column) -> Column:
    return F.xxhash64(F.lit("head"), head)


def hay() -> Column:
    """What a query is looked for in."""
    return F.concat_ws(" ", "statement", "title", F.array_join("aliases", " "))


def entries(facts: DataFrame, part: str = BATCH) -> DataFrame:
    """A part of the index of ``facts``: for batches active ones by words and files and all by families, for searches all by stems and their first bytes."""
    if part == SEARCH:
        # Before the words are exploded, lest they be found once for each of them.
        held = facts.select("id", F.coalesce(text.stems(hay()), F.array().cast("array<string>")).alias("stems"))
        heads = F.array_distinct(F.array_compact(F.transform("stems", text.prefix)))
        return held.select(F.explode(F.concat(F.transform("stems", stem_key), F.transform(heads, head_key))).alias("key"), "id")
    none = F.array().cast("array<bigint>")
    family, active = text.family(F.col("entity_id")), F.col("status") == "active"
    words = text.content_words(F.col("statement"))
    notes = F.filter("source_ids", lambda e: F.startswith(e, F.lit(NOTE)))
    held = facts.select("id", "entity_id", family.alias("family"), active.alias("active"), words.alias("words"), notes.alias("notes"), F.octet_length("statement").alias("length"))
    by_word = F.transform("words", lambda w: word_key(F.col("family"), w))
    anywhere = F.when(F.startswith("entity_id", F.lit("w_")), F.transform("words", workstream_key)).otherwise(none)
    by_file = F.array_distinct(F.transform(F.coalesce("notes", F.array().cast("array<string>")), file_key))
    live = F.when(F.coalesce("active", F.lit(False)), F.concat(by_word, anywhere, by_file)).otherwise(none)
    keys = F.concat(F.array(family_key(F.col("family"))), F.coalesce(live, none))
    return held.select(F.explode(keys).alias("key"), "id", "entity_id", F.size("words").alias("n"), (F.coalesce("length", F.lit(0)) + FACT_BYTES).cast("long").alias("bytes"))


def probes(proposals: DataFrame) -> DataFrame:
    """(id, side, size, key): what proposals (id, entity_id, statement) are looked for under: words of their family, of the preferences and, for preferences, of workstreams."""
    own = text.family(F.col("entity_id"))
    each = proposals.select("id", own.alias("family"), text.content_words(F.col("statement")).alias("words"))
    each = each.select("id", "family", F.size("words").alias("size"), F.explode("words").alias("word"))
    pref = F.col("family") == PREFERENCES
    keys = F.array(
        F.struct(F.lit("own").alias("side"), word_key(F.col("family"), F.col("word")).alias("key")),
        F.struct(F.when(pref, "workstream").otherwise("preferences").alias("side"), F.when(pref, workstream_key(F.col("word"))).otherwise(word_key(F.lit(PREFERENCES), F.col("word"))).alias("key")),
    )
    return each.select("id", "size", F.explode(keys).alias("k")).select("id", "size", "k.side", "k.key")


def similar_ids(probes: DataFrame, found: DataFrame) -> DataFrame:
    """(id): facts among ``found`` entries that share 0.75 of the smaller set of words with what ``probes`` look for.

    A proposal's words are taken rarest first. A fact of m words that shares ceil(0.75 m), or of the
    proposal's n if that is less, has one of them at latest at place n - ceil(0.75 min(m, n)) + 1: so
    frequent words meet short facts only. The pairs that remain are counted over all words.
    """
    df = found.groupBy("key").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id", "side").orderBy("df", "key")
    placed = probes.join(df, "key").withColumn("at", F.row_number().over(order) + F.col("size") - F.count("*").over(Window.partitionBy("id", "side")))
    placed = placed.select(F.col("id").alias("proposal"), "side", "size", "key", "at")
    least = F.ceil(SHARED[0] * F.least("size", "n") / SHARED[1])
    met = placed.join(found.select("key", F.col("id").alias("fact"), "n"), "key")
    pairs = met.filter(F.col("at") <= F.col("size") - least + 1).select("proposal", "side", "fact").distinct()
    shared = met.join(pairs, ["proposal", "side", "fact"], "left_semi").groupBy("proposal", "side", "fact").agg(F.count("*").alias("shared"), F.first("size").alias("size"), F.first("n").alias("n"))
    return shared.filter(F.col("shared") >= least).select(F.col("fact").alias("id")).distinct()
