"""Language identification: multinomial naive Bayes over hashed character n-grams.

Runs of 1 to 3 code points of the lower-cased text are hashed to ``BUCKETS`` buckets; their counts
in all training texts give a matrix of log-probabilities (buckets x languages), whose priors are the
languages' shares of the training texts. The matrix is broadcast in blocks of ``LANGUAGES``
languages at most; each block is one pass within the same scan, which carries the best language so
far. Texts are scored in batches in numpy: the counts of a batch are a sparse matrix of texts and
buckets, and its product with the block is summed in pieces of bounded size.

Defined cases: a text that is null or has no letter gets ``und`` with score 0; so does any text if
nothing was learned; rows without text or language teach nothing; of equal likelihoods the first
language in order of name wins; a text of any length is read whole, in pieces; repeated rows are
each returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import cut, remainder, set_aside, table

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Added to each count of a bucket.
SMOOTHING = 0.1
#: Languages of one broadcast block: 256 MB at most.
LANGUAGES = 2048
#: Distinct counts that a task holds, and cells of a product that are held at once.
HELD, CELLS = 1 << 20, 1 << 22
#: Code points scored at once.
PIECE = 1 << 20
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, in pieces of bounded size."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    for at in range(0, len(points), PIECE):
        own = points[at : at + PIECE + max(ORDERS) - 1]
        for n in ORDERS:
            stop = min(PIECE, len(points) - at - n + 1)
            if stop <= 0:
                continue
            key = np.full(stop, n, np.uint64)
            for k in range(n):
                key = (key * np.uint64(0x100000001B3)) ^ own[k : k + stop]
            yield ((key * _MIX) >> np.uint64(64 - 15)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    """True if any character is a letter."""
    return text is not None and any(map(str.isalpha, text))


def sparse(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bucket, n) of some texts, in order of text, a bounded number of n-grams at a time; a text may come in several parts."""
    held, size = [], 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return keys // BUCKETS, keys % BUCKETS, n

    for k, text in enumerate(texts):
        for buckets in hashed(text):
            held.append(buckets + k * BUCKETS)
            size += len(buckets)
            if size > PIECE:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of ``docs`` (text, lang); each task adds its own up first."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def out() -> pa.RecordBatch:
            keys, n = merged()
            every = pa.array(list(names), pa.string())
            return pa.RecordBatch.from_arrays([every.take(pa.array(keys // BUCKETS)), pa.array(keys % BUCKETS), pa.array(n)], ["lang", "bucket", "n"])

        for batch in stream:
            texts, langs = (c.to_pylist() for c in batch.columns)
            number = np.array([names.setdefault(lang, len(names)) for lang in langs], np.int64)
            for text, bucket, n in sparse(texts):
                held.append((number[text] * BUCKETS + bucket, n))
                if sum(len(k) for k, _ in held) > HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield out()
                        held = []
        if held:
            yield out()

    rows = docs.filter("text is not null and lang is not null").select("text", "lang")
    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Block:
    """Some languages in order of name, the log-probability of each bucket in each, and their log priors."""

    def __init__(self, languages: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.languages, self.matrix, self.prior = languages, matrix, prior

    def likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of each text in each language, n-grams of each text)."""
        total, grams = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts))
        step = max(1, CELLS // len(self.languages))
        for text, bucket, n in sparse(texts):
            grams += np.bincount(text, n, len(texts))
            for k in range(0, len(text), step):
                own = text[k : k + step]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                rows = self.matrix[bucket[k : k + step]] * n[k : k + step, None]
                total[own[first]] += np.add.reduceat(rows, first, axis=0, dtype=np.float64)
        return total, grams


def train(docs: DataFrame) -> list[Block]:
    """Learn from all rows of ``docs`` that have text and language; a name and a number for each language are gathered."""
    known = docs.filter("text is not null and lang is not null")
    shares = dict(known.groupBy("lang").agg(F.count("*").alias("n")).collect())
    languages, size = sorted(shares), sum(shares.values())
    found, out = cut(counts(docs)) if len(languages) > LANGUAGES else counts(docs), []
    for at in range(0, len(languages), LANGUAGES):
        own = languages[at : at + LANGUAGES]
        matrix = np.zeros((BUCKETS, len(own)))
        column = {lang: k for k, lang in enumerate(own)}
        rows = found if len(own) == len(languages) else found.filter(F.col("lang").between(own[0], own[-1]))
        for lang, bucket, n in rows.toLocalIterator():  # BUCKETS rows for each language at most
            matrix[bucket, column[lang]] = n
        matrix += SMOOTHING
        out.append(Block(own, np.log(matrix / matrix.sum(axis=0)).astype(np.float32), np.log([shares[lang] / size for lang in own])))
    return out


def best_of(texts: list[str | None], block: Block, before: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, its log-likelihood, one over its probability) of each text, of a block and what came ``before`` it.

    Probabilities are taken per square root of a text's n-grams, so that long texts stay apart from 1.
    """
    names, top, mass = list(before[0]), before[1].copy(), before[2].copy()
    at = [k for k, text in enumerate(texts) if has_letter(text)]
    if at:
        total, grams = block.likelihoods([texts[k] for k in at])
        best, root = total.argmax(axis=1), np.sqrt(np.maximum(grams, 1))
        most = np.maximum(total[np.arange(len(at)), best], top[at])
        own = np.exp((total - most[:, None]) / root[:, None]).sum(axis=1)
        mass[at] = own + mass[at] * np.exp((top[at] - most) / root)
        for k, j, new in zip(at, best, most > top[at], strict=True):
            names[k] = block.languages[j] if new else names[k]
        top[at] = most
    return names, top, mass


def identified(docs: DataFrame, blocks: list[Block]) -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    at, width, context = docs.columns.index("text"), len(docs.columns), docs.sparkSession.sparkContext
    plain, back = set_aside(docs, ("top",))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)

    def step(sent):
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                if batch.num_rows:
                    texts = batch.column(at).to_pylist()
                    before = (batch.column(width).to_pylist(), batch.column(width + 1).to_numpy(), batch.column(width + 2).to_numpy())
                    names, top, mass = best_of(texts, sent.value, before)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(names, pa.string()), pa.array(top), pa.array(mass)], batch.schema.names)

        return run

    rows = plain.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("score"))
    for block in blocks:
        rows = rows.mapInArrow(step(context.broadcast(block)), f"{out}, lang_pred string, top double, score double")
    return rows.select(*back, "lang_pred", F.when(F.col("score") > 0, 1 / F.col("score")).otherwise(0.0).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those whose remainder by 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held_out))
    return identified(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


QUERIES = {"op8_language_id": query}
ORACLE_SQL: dict[str, str] = {}
