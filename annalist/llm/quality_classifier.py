"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of the whole text are standardised and mapped to ``FEATURES`` random cosines that
approximate a Gaussian kernel. Each partition sums its normal equations, which are then summed by
row in Spark; two folds are solved crosswise for calibration and together for the final weights.
Scores of the training rows, each from the fold it was not in, are counted in ``BINS`` bins and made
monotone by pooling adjacent violators. All labelled rows are used; what reaches the driver is
bounded by FEATURES ** 2 and BINS.

Defined cases: null and empty texts have statistics of zero and get a score like any other; a label
that is null or has no document teaches nothing; a document with several labels counts once for
each; with no label at all every score is 0.5; with one class only, its share; a text of any length
is read whole; repeated rows are each scored; an empty table gives an empty result; other columns
are kept by the filter and ignored by the report.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import cut, giving_back, remainder, set_aside, table
from annalist.llm.quality_rules import base_counts

FEATURES = 256
SEED = 42
RIDGE = 1e-3
BINS = 1024
THRESHOLD = 0.3
STATISTICS = 16

_CLASSES = np.zeros((7, 256))
_CLASSES[0, ord("A") : ord("Z") + 1] = 1
_CLASSES[1, ord("a") : ord("z") + 1] = 1
_CLASSES[2, ord("0") : ord("9") + 1] = 1
_CLASSES[3, [9, 10, 11, 12, 13, 32]] = 1
_CLASSES[4, [ord(c) for c in ".,;:!?'\"()-"]] = 1
_CLASSES[5, [ord(c) for c in "#*$%&|<>{}[]=/\\@^~_+`"]] = 1
_CLASSES[6, 128:] = 1


def statistics(text: str | None) -> list[float]:
    """Sixteen statistics of a whole text."""
    if not text:
        return [0.0] * STATISTICS
    raw = text.encode("utf-8", "replace")
    n_words, chars, symbols, dup_lines, repeated = base_counts(text)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    words = raw.split()
    lines = raw.count(b"\n") + 1
    seen = shares[shares > 0]
    per = 1 / max(n_words, 1)
    return [
        log1p(n_words), chars * per, len(set(words)) * per, symbols * per, dup_lines / lines, repeated * per, log1p(n_words / lines),
        log1p(max(map(len, words), default=0)), float(-(seen * np.log(seen)).sum()), *(_CLASSES @ shares).tolist(),
    ]


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with ``stats``; a column of that name is replaced."""
    docs = docs.drop("stats")
    at = docs.columns.index("text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                found = pa.array([statistics(text) for text in batch.column(at).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "stats"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(giving_back(run), f"{out}, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, STATISTICS)


class Kernel:
    """Standardised statistics to random cosines; the last column is constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        draw = np.random.default_rng(SEED)
        self.weights = draw.normal(size=(STATISTICS, FEATURES)) / STATISTICS**0.5
        self.phases = draw.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([(2 / FEATURES) ** 0.5 * np.cos(x @ self.weights + self.phases), np.ones((len(x), 1))])


def normal_equations(train: DataFrame, kernel: Kernel) -> np.ndarray:
    """[fold, row, column]: sums of z z', with z y and y y in the last row, over the rows (fold, stats, y)."""
    size = FEATURES + 2

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size, size))
        for batch in stream:
            if batch.num_rows:
                z = np.hstack([kernel(_matrix(batch.column(1))), batch.column(2).to_numpy()[:, None]])
                fold = batch.column(0).to_numpy()
                for k in (0, 1):
                    total[k] += z[fold == k].T @ z[fold == k]
        rows = pa.array(list(total.reshape(2 * size, size)), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * size)), rows], ["row", "sums"])

    def add(key, part):
        sums = part.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, size).sum(axis=0)
        return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([sums], pa.list_(pa.float64()))})

    schema = "row long, sums array<double>"
    summed = train.select("fold", "stats", "y").mapInArrow(giving_back(run), schema).groupBy("row").applyInArrow(add, schema)
    out = np.zeros((2 * size, size))
    for row, sums in summed.collect():  # 2 * (FEATURES + 2) rows
        out[row] = sums
    return out.reshape(2, size, size)


def solve(sums: np.ndarray) -> np.ndarray:
    """Ridge weights from summed normal equations; the constant is not shrunk."""
    size = FEATURES + 1
    shrink = np.full(size, RIDGE * max(sums[size - 1, size - 1], 1.0))
    shrink[-1] = 1e-9
    return np.linalg.solve(sums[:size, :size] + np.diag(shrink), sums[:size, size])


def isotonic(counts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """The monotone fit of the positives' share, weighted by counts; bins without rows take a neighbour's."""
    blocks: list[list[float]] = []
    for k in np.flatnonzero(counts):
        blocks.append([float(counts[k]), float(positives[k]), float(k)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, s, at = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + s, at]
    ends = np.array([at for _, _, at in blocks])
    return np.array([s / n for n, s, _ in blocks])[np.minimum(np.searchsorted(ends, np.arange(len(counts))), len(blocks) - 1)]


class Model:
    """Statistics to a calibrated score."""

    def __init__(self, kernel: Kernel | None, weights: np.ndarray, low: float, high: float, levels: np.ndarray):
        self.kernel, self.weights, self.low, self.high, self.levels = kernel, weights, low, high, levels

    def bins(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(((raw - self.low) / (self.high - self.low) * BINS).astype(np.int64), 0, BINS - 1)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(stats), self.levels[0])
        return np.clip(self.levels[self.bins(self.kernel(stats) @ self.weights)], 0, 1)


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from the rows of ``stats`` (doc_id, stats) that ``labels`` (doc_id, quality) has; remainder 0 by 5 is left out."""
    rest = remainder(F.col("doc_id"), 5)
    own = labels.filter("quality is not null and doc_id is not null").select("doc_id", F.when(F.col("quality") >= 1, 1.0).otherwise(0.0).alias("y"))
    known = stats.select("doc_id", "stats").filter(rest != 0)
    rows = cut(known.join(own, "doc_id").select((rest > 2).cast("int").alias("fold"), "stats", "y"))
    each = [F.col("stats")[k] for k in range(STATISTICS)]
    sums = rows.agg(F.count("*"), F.avg("y"), *map(F.avg, each), *map(F.stddev_pop, each)).first()
    n, share = sums[0], sums[1]
    if n == 0 or share in (0.0, 1.0):
        return Model(None, np.zeros(0), 0, 1, np.array([0.5 if n == 0 else share]))
    kernel = Kernel(np.array(sums[2 : 2 + STATISTICS]), np.array(sums[2 + STATISTICS :]))
    by_fold = normal_equations(rows, kernel)
    crosswise = [solve(by_fold[1]), solve(by_fold[0])]
    made = Model(kernel, solve(by_fold.sum(axis=0)), -0.5, 1.5, np.zeros(BINS))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), np.int64)
        for batch in stream:
            if batch.num_rows:
                z, fold, y = kernel(_matrix(batch.column(1))), batch.column(0).to_numpy(), batch.column(2).to_numpy()
                raw = np.where(fold == 0, z @ crosswise[0], z @ crosswise[1])
                for k in (0, 1):
                    total[k] += np.bincount(made.bins(raw[y == k]), minlength=BINS)
        found = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[0][found]), pa.array(total[1][found])], ["bin", "n0", "n1"])

    counts = np.zeros((2, BINS))
    for k, n0, n1 in rows.mapInArrow(giving_back(run), "bin long, n0 long, n1 long").groupBy("bin").agg(F.sum("n0"), F.sum("n1")).collect():  # BINS rows
        counts[:, k] = n0, n1
    made.levels = isotonic(counts.sum(axis=0), counts[1])
    return made


def scored(described_docs: DataFrame, model: Model) -> DataFrame:
    """``described_docs`` with ``score`` in place of ``stats``."""
    docs = described_docs.drop("score")
    kept = [c for c in docs.columns if c != "stats"]
    at, sent = docs.columns.index("stats"), docs.sparkSession.sparkContext.broadcast(model)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                found = pa.array(sent.value(_matrix(batch.column(at))))
                yield pa.RecordBatch.from_arrays([*(batch.column(docs_at) for docs_at in places), found], [*kept, "score"])

    places = [docs.columns.index(c) for c in kept]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return docs.mapInArrow(giving_back(run), f"{out}, score double" if out else "score double")


def filtered(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns.

    Rows are scored where they are read, not joined, so that no text is shuffled.
    """
    labelled = docs.select("doc_id", "text")
    model = train(described(labelled).drop("text"), labels)
    plain, back = set_aside(docs, ("stats", "score"))
    return scored(described(plain), model).filter(F.col("score") >= threshold).select(*back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of all documents, learned from the labels of those whose remainder by 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = cut(described(docs).drop("text"))
    model = train(stats, table(spark, sf_dir, "labels"))
    held_out = remainder(F.col("doc_id"), 5) == 0
    out = scored(stats.select("doc_id", held_out.alias("held_out"), "stats"), model)
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


QUERIES = {"op9_quality_classifier": query}
ORACLE_SQL: dict[str, str] = {}
