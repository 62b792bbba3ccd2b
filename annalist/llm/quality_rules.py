"""Quality rules: counts of words and symbols, and n-gram perplexity bands for each language.

The language model is a modified Kneser-Ney model of order 5 over code points, A-Z lower-cased and
otherwise as they are, so that any script is modelled. Spark counts the n-grams of all texts; lower
orders hold continuation counts; three discounts for each order come from the counts of counts;
probabilities and back-off weights are computed by joins, order by order, so that no process holds
the model. What scoring needs is one number for each n-gram and each context, which add up to the
log-probability of a symbol: they are stored as sorted hash arrays and broadcast in blocks of at
most ``BLOCK`` entries. A model of several blocks is applied block by block, whose sums are added.

A text passes if its log-perplexity per symbol lies in the band of its language: quartiles of all
texts of that language, counted in bins of 0.005, widened by ``SPREAD`` interquartile ranges. Every
language has a band of its own, however few its texts.

Defined cases: a null text has no words, fails the base rules and is not kept; so does any text of
under 50 words; a null language is a language of its own; a text of any length is read whole;
repeated rows are each judged; an empty table gives an empty result; other columns are kept by the
filter and ignored by the report.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.common import cut, giving_back, row_hash, set_aside, table

ORDER = 5
LEAST_WORDS = 50
SPREAD = 3.0
BIN = 0.005
#: Languages whose bands are broadcast.
SENT = 10_000
#: Entries of the model that are broadcast at once, 16 bytes each.
BLOCK = 1 << 22
#: Distinct n-grams that a task holds before it passes them on, and symbols that are looked up at once.
HELD, PIECE = 1 << 19, 1 << 18
#: The largest log-perplexity that has a bin of its own.
TOP = 40.0
MARKS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Bits of a symbol, and the symbol that stands before and after each text.
SYMBOL, EDGE = 21, 0x110000
#: What marks the key of a sum in the model; up to 2 * ORDER, n-grams and contexts have their lengths.
WHOLE = 2 * ORDER + 1


# ---- base rules


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, code points in words, mark symbols, repeated lines, words in repeated 3-word windows)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, MARKS))
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    put = number.setdefault
    ids = np.fromiter((put(word, len(number)) for word in words), np.int64, len(words))
    n = len(number)
    if n < 1 << 21:
        keys = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:  # three numbers would not fit: number the pairs first
        _, pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
        keys = pairs[:-1] * n + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(keys)] |= twice
    return int(hit.sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    """The base verdict."""
    return n_words < LEAST_WORDS or 100 * n_repeat_words > 50 * n_words


# ---- symbols and n-grams


def windows(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(high, low, text number) of each n-gram of full order, some texts at a time.

    One ends at each code point of a text and at its end. The first two symbols are packed into
    ``high``, the last three into ``low``. An empty or null text has none.
    """
    held, size = [], 0
    for k, text in enumerate([*texts, None]):
        if text:
            points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
            points[(points >= 65) & (points <= 90)] += 32
            held.append((k, points))
            size += len(points)
        if held and (size >= PIECE or k == len(texts)):
            edge = np.full(ORDER, EDGE, np.int64)
            symbols = np.concatenate([edge[:-1], *(x for _, own in held for x in (own, edge))])
            high = symbols[: 1 - ORDER] << SYMBOL | symbols[1 : 2 - ORDER]
            low = symbols[2 : 3 - ORDER] << 2 * SYMBOL | symbols[3:-1] << SYMBOL | symbols[4:]
            lengths = np.array([len(own) for _, own in held])
            starts = np.cumsum(lengths + ORDER) - lengths - ORDER
            owner = np.repeat(np.arange(len(held)), lengths + 1)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1) + starts[owner]
            yield high[at], low[at], np.array([n for n, _ in held])[owner]
            held, size = [], 0


def ending(high, low, order: int):
    """The last ``order`` symbols of n-grams, for arrays and for columns."""
    mask = lambda x, n: x.bitwiseAND((1 << n * SYMBOL) - 1) if isinstance(x, Column) else x & ((1 << n * SYMBOL) - 1)
    return (mask(high, max(order - 3, 0)), mask(low, min(order, 3)))


def context(high, low):
    """All symbols but the last."""
    if isinstance(high, Column):
        return F.shiftright(high, SYMBOL), F.shiftleft(high.bitwiseAND((1 << SYMBOL) - 1), 2 * SYMBOL).bitwiseOR(F.shiftright(low, SYMBOL))
    return high >> SYMBOL, (high & (1 << SYMBOL) - 1) << 2 * SYMBOL | low >> SYMBOL


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct key, how often it occurs, the number of each place's key)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts, number = np.flatnonzero(new), np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new) - 1
    return order[starts], np.diff(starts, append=len(keys)), number


def counts(docs: DataFrame) -> DataFrame:
    """(high, low, n): how often each n-gram of full order occurs in all texts of ``docs``."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            high, low, n = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = np.lexsort((low, high))
            high, low, n = high[order], low[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(high) != 0) | (np.diff(low) != 0)]))
            return high[new], low[new], np.add.reduceat(n, new)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["high", "low", "n"])

        for batch in stream:
            for high, low, _ in windows(batch.column(0).to_pylist()):
                first, n, _ = _grouped(row_hash(high, low))
                held.append((high[first], low[first], n))
                if sum(len(x[2]) for x in held) > HELD:
                    held = [merged()]
                    if len(held[0][2]) > HELD // 2:
                        yield out()
                        held = []
        if held:
            yield out()

    return docs.select("text").mapInArrow(giving_back(run), "high long, low long, n long").groupBy("high", "low").agg(F.sum("n").alias("n"))


# ---- the model


def discounts(grams: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from all counts of counts of an order."""
    n1, n2, n3, n4 = grams.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).first()
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1)]


class Model:
    """(key, value) of each n-gram and context in broadcast blocks of sorted hash arrays, and the value of a symbol that no text holds."""

    def __init__(self, blocks: list, unseen: float):
        self.blocks, self.unseen = blocks, unseen


def values(grams: DataFrame) -> tuple[DataFrame, float]:
    """(key, value, part) for the model of counted n-grams of full order, and the value of an unknown symbol.

    A symbol's log-probability after a context is ``unseen`` and the values of the contexts of all
    lengths before it and of the n-grams of all lengths that end with it, those that exist. For an
    n-gram of full order their sum is given as well (part ``sum``, beside ``longest`` and ``rest``).
    """
    own = {ORDER: grams}
    for n in range(ORDER - 1, 0, -1):
        # The continuation count of a shorter n-gram: the symbols that were seen before it.
        high, low = ending(F.col("high"), F.col("low"), n)
        own[n] = cut(own[n + 1].select(high.alias("high"), low.alias("low")).groupBy("high", "low").agg(F.count("*").alias("n")))
    shorter, found, unseen = None, [], 0.0
    for n in range(1, ORDER + 1):
        cuts = discounts(own[n])
        taken = F.element_at(F.array(*map(F.lit, cuts)), F.least(F.col("n"), F.lit(3)).cast("int"))
        rows = own[n].withColumn("d", taken)
        if n == 1:
            total, lost, symbols = rows.agg(F.sum("n"), F.sum("d"), F.count("*")).first()
            if not total:
                return grams.select(F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("value"), F.lit("").alias("part")), 0.0
            weight = lost / total
            unseen = float(np.log(weight / (symbols + 1)))
            shorter = cut(rows.select("high", "low", ((F.col("n") - F.col("d")) / total + F.lit(weight / (symbols + 1))).alias("p")))
            found.append(shorter.select(F.xxhash64("high", "low", F.lit(n).cast("long")).alias("key"), (F.log("p") - unseen).alias("value"), F.lit("rest").alias("part")))
            continue
        before = context(F.col("high"), F.col("low"))
        after = Window.partitionBy("before_high", "before_low")
        rows = rows.withColumns({"before_high": before[0], "before_low": before[1]}).withColumns({"total": F.sum("n").over(after), "lost": F.sum("d").over(after)})
        end_high, end_low = ending(F.col("high"), F.col("low"), n - 1)
        rows = rows.withColumns({"weight": F.col("lost") / F.col("total"), "own": (F.col("n") - F.col("d")) / F.col("total"), "end_high": end_high, "end_low": end_low})
        less = shorter.select(F.col("high").alias("end_high"), F.col("low").alias("end_low"), F.col("p").alias("less"))
        rows = cut(rows.join(less, ["end_high", "end_low"]).select("high", "low", "before_high", "before_low", "weight", "less", (F.col("own") + F.col("weight") * F.col("less")).alias("p")))
        value = F.log("p") - F.log("weight") - F.log("less")
        part = F.lit("longest" if n == ORDER else "rest")
        if n == ORDER:
            found.append(rows.select(F.xxhash64("high", "low", F.lit(WHOLE).cast("long")).alias("key"), (F.log("p") - unseen).alias("value"), F.lit("sum").alias("part")))
        found.append(rows.select(F.xxhash64("high", "low", F.lit(n).cast("long")).alias("key"), value.alias("value"), part.alias("part")))
        contexts = rows.groupBy("before_high", "before_low").agg(F.first("weight").alias("weight"))
        found.append(contexts.select(F.xxhash64("before_high", "before_low", F.lit(ORDER + n).cast("long")).alias("key"), F.log("weight").alias("value"), F.lit("rest").alias("part")))
        shorter = rows.select("high", "low", "p")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return cut(out), unseen


def model(docs: DataFrame) -> Model:
    """The model of all texts of ``docs``, in blocks by ranges of the hash."""
    entries, unseen = values(cut(counts(docs)))
    n = -(-entries.filter("part <> 'sum'").count() // BLOCK)
    # Of one block, an n-gram of full order is known by its sum; sums cannot be added up from several.
    entries = entries.filter(F.col("part") != F.lit("longest" if n == 1 else "sum"))
    blocks = []
    for k in range(n):
        rows = entries.filter(F.pmod("key", F.lit(n)) == k).select("key", "value").toArrow()
        keys, order = _sorted(rows["key"].to_numpy())
        blocks.append((keys, rows["value"].to_numpy()[order]))
    return Model([docs.sparkSession.sparkContext.broadcast(block) for block in blocks], unseen)


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], order


def _found(block: tuple[np.ndarray, np.ndarray], name: int, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is it there, its value or 0) of keys."""
    keys, held = block
    own = row_hash(high, low, np.full(1, name, np.int64))
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    there = keys[at] == own
    return there, np.where(there, held[at], 0.0)


def looked_up(block: tuple[np.ndarray, np.ndarray], high: np.ndarray, low: np.ndarray, only: bool = False) -> np.ndarray:
    """The sum of a block's values for the last symbol of each n-gram of full order; of the ``only`` block known sums are taken whole."""
    out, rest = np.zeros(len(high)), np.arange(len(high))
    if only:
        there, out = _found(block, WHOLE, high, low)
        rest = np.flatnonzero(~there)
        high, low = high[rest], low[rest]
    for n in range(1, ORDER + 1):
        end = ending(high, low, n)
        out[rest] += _found(block, n, *end)[1]
        if n > 1:
            out[rest] += _found(block, ORDER + n, *context(*end))[1]
    return out


def sums(block: tuple[np.ndarray, np.ndarray], texts: list[str | None], only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sum of a block's values, number of symbols) of each text."""
    total, size = np.zeros(len(texts)), np.zeros(len(texts))
    for high, low, owner in windows(texts):
        first, _, inverse = _grouped(row_hash(high, low))
        total += np.bincount(owner, looked_up(block, high[first], low[first], only)[inverse], len(texts))
        size += np.bincount(owner, minlength=len(texts))
    return total, size


# ---- bands and verdicts


_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_perplexity double"
_NAMES = [field.split()[0] for field in _BASE.split(", ")]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the base counts and ``log_perplexity`` (0 for a null or empty text); columns of these names are replaced.

    Each block of the model adds its part in the same pass over the rows.
    """
    docs = docs.drop(*_NAMES)
    at, width = docs.columns.index("text"), len(docs.columns)
    unseen, only = model.unseen, len(model.blocks) == 1

    def step(sent, first: bool):
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                if not batch.num_rows:
                    continue
                texts = batch.column(at).to_pylist()
                more, size = sums(sent.value, texts, only) if sent else (np.zeros(len(texts)), np.zeros(len(texts)))
                more = -more / np.maximum(size, 1)
                columns, names = batch.columns[:width], batch.schema.names[:width]
                if first:
                    rows = [(*c, base_failed(c[0], c[4])) for c in map(base_counts, texts)]
                    more -= np.where(size > 0, unseen, 0.0)
                    columns += [pa.array(list(v)) for v in zip(*rows, strict=True)]
                else:
                    more += batch.column(batch.num_columns - 1).to_numpy()
                    columns += batch.columns[width:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(more)], [*names, *_NAMES])

        return run

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for k, block in enumerate(model.blocks or [None]):
        docs = docs.mapInArrow(giving_back(step(block, k == 0)), f"{out}, {_BASE}")
    return docs


def bands(found: DataFrame) -> DataFrame:
    """(band_lang, band_low, band_high): the band of each language's texts that pass the base rules.

    ``found`` has lang, base_failed and log_perplexity; TOP / BIN bins for each language at most are gathered.
    """
    code = F.floor(F.least(F.col("log_perplexity"), F.lit(TOP)) / BIN).alias("bin")
    bins = found.filter("not base_failed").groupBy("lang", code).agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang")
    bins = bins.withColumns({"upto": F.sum("n").over(own.orderBy("bin")), "all": F.sum("n").over(own)})
    at = [(F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) + 0.5) * BIN for q in (0.25, 0.75)]
    rows = bins.groupBy("lang").agg(at[0].alias("low"), at[1].alias("high"))
    room = SPREAD * F.greatest(F.col("high") - F.col("low"), F.lit(BIN))
    return cut(rows.select(F.col("lang").alias("band_lang"), (F.col("low") - room).alias("band_low"), (F.col("high") + room).alias("band_high")))


def verdict(found: DataFrame, limits: DataFrame) -> DataFrame:
    """``found`` with ``kept``: the base rules passed and the log-perplexity within its band."""
    # A row for each language: small enough to send, unless the column holds no languages at all.
    rows = F.broadcast(limits) if limits.limit(SENT + 1).count() <= SENT else limits
    both = found.join(rows, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(False))
    return both.withColumn("kept", ~F.col("base_failed") & inside).drop("band_lang", "band_low", "band_high")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, the base counts, base_failed, log_perplexity, kept) for each row of ``docs``."""
    found = cut(scored(docs.select("doc_id", "lang", "text"), model(docs)).drop("text"))
    return verdict(found, bands(found))


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Rows are judged where they are read, not joined, so that no text is shuffled.
    """
    made = model(docs)
    limits = bands(scored(docs.select("doc_id", "lang", "text"), made).drop("text"))
    plain, back = set_aside(docs, (*_NAMES, "band_lang", "band_low", "band_high", "kept"))
    return verdict(scored(plain, made), limits).filter("kept").select(*back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict on all documents."""
    return judged(table(spark, sf_dir, "documents")).drop("lang")


QUERIES = {"op3_quality_rules": query}
ORACLE_SQL: dict[str, str] = {}
