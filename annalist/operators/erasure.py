"""Erasure by needle: what must not be found any more, in any text of any revision."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the needles that are sought at once.
BLOCK_CHARS = 2**20


class Needles:
    """Ids and statements of one erasure, which are a family's at most, in one automaton.

    An id counts as a whole word, so that it does not match a longer one; a statement anywhere.
    """

    def __init__(self, ids: list[str], statements: list[str | None]):
        self.ids, self.statements = sorted({i for i in ids if i}), sorted({s for s in statements if s})
        self._automaton = ahocorasick.Automaton()
        for needle, whole in [*((i, True) for i in self.ids), *((s, False) for s in self.statements)]:
            known = self._automaton.get(needle, None)
            self._automaton.add_word(needle, (len(needle), whole and (known is None or known[1])))
        if len(self._automaton):
            self._automaton.make_automaton()

    def within(self, text: str | None) -> bool:
        """True if a text holds a needle."""
        if not text or not len(self._automaton):
            return False
        for end, (size, whole) in self._automaton.iter(text):
            begin = end - size + 1
            if not whole or not (begin and _in_word(text[begin - 1])) and not (end + 1 < len(text) and _in_word(text[end + 1])):
                return True
        return False

    def scrubbed(self, text: str) -> str:
        """A text without the lines that hold a needle."""
        return "".join(line for line in text.splitlines(keepends=True) if not self.within(line))


def _in_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def sought(ids: DataFrame, statements: DataFrame) -> DataFrame:
    """(needle, is_id, is_statement): the needles of an erasure, any number of them, from (id) and (statement)."""
    named = ids.select(F.col("id").alias("needle"), F.lit(True).alias("is_id"), F.lit(False).alias("is_statement"))
    said = statements.select(F.col("statement").alias("needle"), F.lit(False).alias("is_id"), F.lit(True).alias("is_statement"))
    return named.unionByName(said).filter("needle <> ''").groupBy("needle").agg(F.max("is_id").alias("is_id"), F.max("is_statement").alias("is_statement"))


def touched(facts: DataFrame, needles: DataFrame) -> DataFrame:
    """(id, own, evidence, aliases): what ``cleaned`` does to rows of ``facts`` (with ``gone``), for those that it removes or changes.

    Whether a row is one of the needles' ``own``, whether its evidence holds one, and which of its
    aliases do. Evidence and aliases are compared with the needles that are no longer than they,
    a bounded number of characters at a time, each time by one automaton in all tasks.
    """
    rows = facts.filter("not gone").select("id", "statement", "evidence", "aliases")
    none = F.array().cast("array<string>")
    # Statements meet by their digests: only these are shuffled.
    digest = lambda c: F.sha2(c, 256).alias("_digest")
    by_id = rows.select("id").join(needles.filter("is_id").select(F.col("needle").alias("id")), "id", "left_semi")
    by_statement = rows.select("id", digest("statement")).join(needles.filter("is_statement").select(digest("needle")), "_digest", "left_semi").select("id")
    out = by_id.unionByName(by_statement).select("id", F.lit(True).alias("own"), F.lit(False).alias("evidence"), none.alias("aliases"))
    longest = rows.agg(F.max(F.greatest(F.char_length("evidence"), F.array_max(F.transform("aliases", F.char_length))))).first()[0] or 0
    short = needles.filter(F.char_length("needle") <= longest)
    held = short.agg(F.sum(F.char_length("needle"))).first()[0] or 0
    blocks = 1 + held // BLOCK_CHARS
    block = F.pmod(F.xxhash64("needle"), F.lit(blocks))

    def run(own: Needles):
        def found(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                hits = [(i, own.within(e), [x for x in a or [] if own.within(x)]) for i, e, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                hits = [h for h in hits if h[1] or h[2]]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.string()), pa.array([False] * len(hits), pa.bool_()), pa.array([h[1] for h in hits], pa.bool_()), pa.array([h[2] for h in hits], pa.list_(pa.string()))], names=["id", "own", "evidence", "aliases"])

        return found

    for k in range(blocks if held else 0):
        some = short.filter(block == k).collect()  # of bounded size
        own = Needles([r.needle for r in some if r.is_id], [r.needle for r in some if r.is_statement])
        out = out.unionByName(rows.select("id", "evidence", "aliases").mapInArrow(run(own), "id string, own boolean, evidence boolean, aliases array<string>"))
    return out.groupBy("id").agg(F.max("own").alias("own"), F.max("evidence").alias("evidence"), F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("aliases"))


def cleaned(facts: DataFrame, hits: DataFrame) -> DataFrame:
    """``facts`` (with ``gone``) without those of the needles' ids and statements; evidence and aliases of others that hold a needle are emptied.

    ``hits`` are what ``touched`` finds in them. An id that is named as removed stays so.
    """
    both = facts.join(hits.select(F.col("id").alias("_id"), "own", F.col("evidence").alias("_evidence"), F.col("aliases").alias("_aliases")), (F.col("id") == F.col("_id")) & ~F.col("gone"), "left")
    kept = both.filter("_id is null or not own")
    clean = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: ~F.coalesce(F.array_contains(F.col("_aliases"), a), F.lit(False)))
    emptied = {"evidence": F.when(F.coalesce("_evidence", F.lit(False)), F.lit(None)).otherwise(F.col("evidence")), "aliases": F.when(F.col("_id").isNotNull(), clean).otherwise(F.col("aliases"))}
    return kept.select(*(emptied[c].alias(c) if c in emptied else F.col(c) for c in facts.columns))
