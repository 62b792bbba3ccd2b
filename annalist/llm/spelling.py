"""Spelling variants: words one code point apart, found by automata that hold the words' halves.

Two words are near if one insertion, deletion or replacement of a code point makes one the other.
The place where they part lies in one half of the shorter word, or of either of two equally long
ones, so that the other half stands in the longer word unchanged: the first half at its beginning,
the second at its end. The halves are dealt by their hash to shards, each held as an Aho-Corasick
automaton. Every word is sent to the shards that may hold a half of it and scanned there once; of
the segments found, those at the right end and of words of a fitting length are verified. The pair
is reported by the segment that leaves out the place where the words first part, hence once.

A half that many words share, such as a common beginning, is refined: each of its words goes by
longer segments instead, which leave out only one half of what the shared one leaves out, and so on
until few words share a segment or it leaves out one code point. So no shard grows with a hot half.

Every word is then joined to the numbers of its near words; forms are followed to the last by
doubling, in as many rounds as the logarithm of the longest possible chain takes.

Defined cases: a null or empty text has no words; a null doc_id counts as the empty id where
documents are altered; a word of any length takes part; repeated rows count each; ties of forms go to
the least word; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import batches, cut, giving_back, table

#: Code points of a word and its occurrences, at least; how much more often a form occurs.
SHORTEST, OCCURS, MORE = 6, 5, 5
#: One in so many occurrences is altered by the query.
ALTERED = 199
#: Words of a segment beyond which it is refined, and segments of a shard.
HOT, SHARD = 64, 1 << 12


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, run): the runs of letters of ``docs`` (doc_id, text) that are long enough, A-Z lower-cased."""
    runs = F.regexp_extract_all("text", F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{SHORTEST},}})"), F.lit(1))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", upper, upper.lower()).alias("run"))


def altered(found: DataFrame) -> DataFrame:
    """(word): the runs, of which those that the hash of document and run picks lose one code point."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(h % ALTERED == 0, shorter).otherwise(F.col("run"))
    return found.select(word.alias("word")).filter(F.length("word") >= SHORTEST)


# ---- segments


def _segments(words: DataFrame, longer: int) -> DataFrame:
    """``words`` (word, n) with the two segments of a word that is ``longer`` code points shorter: those that leave out [low, high) of it.

    ``size`` is the length of the shorter word; what a segment leaves out is between ``low`` code
    points at the beginning and ``size - high`` at the end.
    """
    size = F.length("word") - longer
    half = (size / 2).cast("int")
    sides = F.array(F.struct(half.alias("low"), size.alias("high")), F.struct(F.lit(0).alias("low"), half.alias("high")))
    each = words.filter(size >= SHORTEST).select("word", "n", size.alias("size"), F.explode(sides).alias("out"))
    return _keyed(each.select("word", "n", "size", "out.low", "out.high"))


def _keyed(each: DataFrame) -> DataFrame:
    """With the hash of the segment: where it lies, and its code points."""
    begin = F.expr("substring(word, 1, low)")
    end = F.expr("substring(word, length(word) - size + high + 1, size - high)")
    return each.withColumn("key", F.xxhash64("size", "low", "high", begin, end))


def _finer(each: DataFrame) -> DataFrame:
    """Each segment as the two that leave out one half of what it leaves out."""
    middle = F.expr("low + (high - low) div 2")
    sides = F.array(F.struct(middle.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), middle.alias("high")))
    return _keyed(each.select("word", "n", "size", "held", F.explode(sides).alias("out")).select("word", "n", "size", "held", "out.low", "out.high"))


def segments(words: DataFrame) -> DataFrame:
    """(word, n, size, low, high, key, held): segments of ``words`` (word, n) that the automata hold, and those under which words are to be looked for."""
    each = _segments(words, 0).withColumn("held", F.lit(True))
    each = each.unionByName(each.withColumn("held", F.lit(False))).unionByName(_segments(words, 1).withColumn("held", F.lit(False)))
    ready = None
    while True:
        each = cut(each)
        many = each.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.col("high") - F.col("low")).alias("out"))
        hot = cut(many.filter((F.col("rows") > HOT) & (F.col("out") > 1)).select("key"))
        if hot.isEmpty():
            return each if ready is None else ready.unionByName(each)
        fine = each.join(hot, "key", "left_anti")
        ready = fine if ready is None else ready.unionByName(fine)
        each = _finer(each.join(hot, "key", "left_semi"))


def parting(a: str, b: str) -> int | None:
    """Where ``b``, as long as ``a`` or one longer, first differs from it, if they differ by one code point; else None."""
    n = len(a)
    low, high = 0, n  # a[:low] agrees; bisection compares slices
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    if len(b) > n:
        return low if a[low:] == b[low + 1 :] else None
    return low if low < n and a[low + 1 :] == b[low + 1 :] else None


Held = tuple[str, int, int, int, int]  #: word, n, size, low, high


def matches(held: list[Held], words: dict[str, int]) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, longer or equal word, its n) for near words, one of them ``held`` in an automaton by its segment, the other scanned."""
    automaton = ahocorasick.Automaton()
    by: dict[str, list[tuple[bool, Held]]] = {}
    for entry in held:
        word, _, size, low, high = entry
        first = low >= size - high  # the longer part goes into the automaton, both are verified
        by.setdefault(word[:low] if first else word[high:], []).append((first, entry))
    for segment, entries in by.items():
        automaton.add_word(segment, (len(segment), entries))
    if not by:
        return
    automaton.make_automaton()
    for word, n in words.items():
        last = len(word) - 1
        for at, (length, entries) in automaton.iter(word):
            begins, ends = at == length - 1, at == last
            if not (begins or ends):
                continue
            for first, (other, m, size, low, high) in entries:
                if not (begins if first else ends) or not (size + 1 == len(word) or size == len(word) and other < word):
                    continue
                place = parting(other, word)
                if place is not None and low <= min(place, size - 1) < high:
                    yield other, m, word, n


def pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): all pairs of near words of ``words`` (word, n), each once."""
    every = segments(words)
    count = max(1, every.filter("held").count() // SHARD)
    shard = F.pmod("key", F.lit(count)).cast("int")
    # A word is scanned once in each shard; a segment under which it is looked for leads it there.
    looked = every.filter("not held").select(shard.alias("shard"), "word", "n").distinct().select("shard", F.lit(False).alias("held"), "word", "n", *(F.lit(0).alias(c) for c in ("size", "low", "high")))
    dealt = every.filter("held").select(shard.alias("shard"), "held", "word", "n", "size", "low", "high").unionByName(looked)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[Held] = []
        words: dict[str, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            found = list(matches(held, words))
            for k in range(0, len(found), 1 << 14):
                columns = list(zip(*found[k : k + (1 << 14)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(columns, [pa.string(), pa.int64()] * 2, strict=True)], ["word", "n", "other", "other_n"])

        for columns in batches(stream):
            for own, is_held, word, n, *places in zip(*columns, strict=True):
                if own != now:
                    yield from out()
                    now, held, words = own, [], {}
                if is_held:
                    held.append((word, n, *places))
                else:
                    words[word] = n
        yield from out()

    return dealt.repartition(count, "shard").sortWithinPartitions("shard").mapInArrow(giving_back(run), "word string, n long, other string, other_n long")


# ---- forms


def _better(n: Column, word: Column) -> Column:
    """What is least for the near word of largest n, ties by code points."""
    return F.struct((-n).alias("less"), word.alias("word"))


def grouped(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n)."""
    near = cut(pairs(words))
    both = near.select("word", "other", "other_n").unionByName(near.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(_better(F.col("other_n"), F.col("other"))).alias("best"))
    joined = words.join(best, "word", "left")
    formed = -F.col("best.less") >= MORE * F.col("n")
    forms = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    forms = cut(forms)
    # Each step multiplies n by MORE at least, so that chains are short.
    most = forms.agg(F.max("n")).first()[0] or 1
    steps = int(np.ceil(np.log(max(most, OCCURS)) / np.log(MORE))) + 1
    roots = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(int(np.ceil(np.log2(steps)))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = cut(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(occurring: DataFrame) -> DataFrame:
    """(word, n): the words that occur often enough among ``occurring`` (word), cut."""
    return cut(occurring.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= OCCURS))


def variants(docs: DataFrame) -> DataFrame:
    """Spelling variants of the words of ``docs`` (doc_id, text) as they stand."""
    return grouped(vocabulary(occurrences(docs).select(F.col("run").alias("word"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents, some occurrences of which are altered."""
    return grouped(vocabulary(altered(occurrences(table(spark, sf_dir, "documents")))))


QUERIES = {"op11_spelling_variants": query}
ORACLE_SQL = {
    "op11_spelling_variants": r"""
with recursive crc_table as (
  select list_transform(range(0, 256), lambda b: list_reduce(list_prepend(cast(b as bigint), cast(range(0, 8) as bigint[])), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) as t),
runs as (
  select cast(doc_id as varchar) as d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]{6,}')) as run
  from documents where text is not null),
each as (select d, run, count(*) as n from runs group by d, run),
bytes as (
  select d, run, n, hex(encode(coalesce(d, '') || ':' || run)) as x from each),
hashed as (
  select run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, cast(length(x) / 2 as bigint)), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint))),
                 lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) as h
  from bytes, crc_table),
counted as (
  select word, cast(sum(n) as bigint) as n
  from (select n, case when h % 199 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word from hashed)
  where length(word) >= 6 group by word having sum(n) >= 5),
less as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(0, length(word))) as i from counted)),
near as (
  select distinct a.word, b.word as other, b.n as other_n from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from less a join counted b on a.rest = b.word
  union select b.word, a.word, a.n from less a join counted b on a.rest = b.word),
best as (select word, count(*) as n_near, max(other_n) as top from near group by word),
least as (select near.word, min(other) as form from near join best on near.word = best.word and other_n = top group by near.word),
forms as (
  select c.word, c.n, coalesce(n_near, 0) as n_near, case when top >= 5 * c.n then form end as form, case when top >= 5 * c.n then top end as form_n
  from counted c left join best on c.word = best.word left join least on c.word = least.word),
chain as (
  select word, word as root, form as next from forms
  union all select chain.word, forms.word, forms.form from chain join forms on chain.next = forms.word)
select forms.word, forms.form, chain.root, forms.n, forms.n_near, forms.form_n
from forms join chain on forms.word = chain.word and chain.next is null"""
}
