"""SimHash near-duplicate classes by the generalised pigeonhole principle.

Fingerprints of 64 bits link when at most ``radius`` bits differ. The bits are dealt into m blocks,
correlated bits together. For every fingerprint thresholds t_1..t_m with sum ``radius - m + 1``
are chosen (-1: the block is not probed): any fingerprint within the radius must be within t_i in
some block i. A dynamic program picks those thresholds that promise the fewest candidates, as
estimated from histograms of all fingerprints; probes then meet the index in an equi-join and are
verified on the whole fingerprint.

Two passes keep the links of a cluster of many different near copies linear in its size. First each
fingerprint is compared with a few that every other one under the same block value is compared with
too; what links makes first classes. The probes then link only fingerprints of different first
classes. No link between classes is lost, and those within a class change nothing.

``deduplicated`` asks for texts whose five-word shingles are similar by ``SIMILARITY``. A wide
fingerprint of 256 bits estimates that similarity from the share of differing bits; its first 64 bits
find the candidates, with a radius that such pairs seldom exceed, and all its bits verify them.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and is linked
like any other; equal texts share a fingerprint and so a class; rows that repeat a doc_id are each
returned, with the class of their own text; a null doc_id is returned with its fingerprint and its
class, whose id is null if no row of the class has one; a text of any length is read whole; an empty
table gives an empty result; other columns are ignored, and kept where documents are filtered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import batches, cut, giving_back, set_aside, table

BITS = 64
SHINGLE = 4
SEED = 42
RADIUS = 4
#: Words of a wide fingerprint, the shingle and similarity of ``deduplicated``, and the radius of its candidates.
WIDE, STAGE_SHINGLE, SIMILARITY, STAGE_RADIUS = 4, 5, 0.8, 10
#: A probe is made, shuffled and sorted; its price in verified candidates.
PROBE_COST = 64.0
#: The largest threshold of one block; a ball of radius 3 in a block is never the cheapest here.
MAX_THRESHOLD = 2
#: Widest part of a block for which a histogram is kept: 2 ** 11 counts.
PART_BITS = 11
#: Shingles that are hashed at once, so that a very long text needs bounded memory.
CHUNK = 1 << 18


# ---- fingerprints


def fingerprint(text: bytes | None, size: int = SHINGLE, wide: int = 1) -> list[int]:
    """The SimHash of a text's word shingles, 64 bits for each of ``wide`` seeds: bit set if set in over half of the hashes."""
    words = (text or b"").lower().split()
    if not words:
        return [0] * wide
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths) + np.arange(len(words))
    starts = ends - lengths
    if len(words) <= size:
        starts, ends = starts[:1], ends[-1:]
    else:
        ends = ends[size - 1 :]
        starts = starts[: len(ends)]
    digest, counts = xxhash.xxh64_intdigest, np.zeros((wide, BITS), np.int64)
    for k in range(0, len(ends), CHUNK):
        spans = zip(starts[k : k + CHUNK].tolist(), ends[k : k + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        for w in range(wide):
            if w:  # a hash of the hash
                hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(w)
                hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
                hashes ^= hashes >> np.uint64(29)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[w] += bits.sum(axis=0, dtype=np.int64)
    return [int(np.packbits(2 * own > len(ends), bitorder="little").view("<u8")[0]) for own in counts]


def fingerprints(docs: DataFrame, size: int = SHINGLE, wide: int = 1) -> DataFrame:
    """``docs`` with fp and, of a wide fingerprint, w1 and so on; each holds 64 bits as a signed long. Columns of these names are replaced."""
    names = ["fp", *(f"w{k}" for k in range(1, wide))]
    docs = docs.drop(*names)
    at = docs.columns.index("text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                found = np.array([fingerprint(text, size, wide) for text in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(wide))], [*batch.schema.names, *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(giving_back(run), f"{own}, " + ", ".join(f"{n} long" for n in names))


# ---- blocks of correlated bits


def _fps(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in stream:
        if batch.num_rows:
            yield batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)


def bit_sums(distinct: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints in which bits i and j are both set, over all fingerprints."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for fps, _ in _fps(stream):
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += (bits.T @ bits).astype(np.int64)
        cell = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], ["cell", "n"])

    sums = distinct.mapInArrow(giving_back(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(BITS * BITS, np.int64)
    for cell, n in sums.collect():  # 4,096 rows at most
        out[cell] = n
    return out.reshape(BITS, BITS)


def correlated_blocks(sums: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Deal the bits into m blocks of nearly equal width, each grown around its most correlated bits."""
    p = sums / max(n, 1)
    own = np.diag(p)
    spread = np.sqrt(np.maximum(own * (1 - own), 1e-12))
    corr = np.abs((p - np.outer(own, own)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, blocks = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        rest = sorted(left)
        block = [max(rest, key=lambda b: (corr[b, rest].max(), -b))]
        left.discard(block[0])
        while len(block) < width:
            block.append(max(sorted(left), key=lambda b: (corr[b, block].sum(), -b)))
            left.discard(block[-1])
        blocks.append(sorted(block))
    return blocks


def ball(width: int, radius: int) -> int:
    """Values of ``width`` bits within ``radius`` of a given one."""
    return sum(math.comb(width, e) for e in range(radius + 1)) if radius >= 0 else 0


def block_count(n: int, radius: int = RADIUS) -> int:
    """The m from 2 to radius + 1 that costs least for n evenly spread fingerprints."""

    def cost(m: int) -> float:
        width, spare = BITS / m, radius - m + 1
        thresholds = [spare // m + (i < spare % m) for i in range(m)]
        return sum(ball(round(width), t) * (PROBE_COST + n / 2**width) for t in thresholds)

    return min(range(max(2, -(-radius // MAX_THRESHOLD)), radius + 2), key=cost)


def gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each fingerprint, packed from the lowest upward."""
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def part_counts(distinct: DataFrame, parts: list[list[int]]) -> list[np.ndarray]:
    """For each part of a block, how many fingerprints hold each of its values."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << len(bits), np.int64) for bits in parts]
        for fps, _ in _fps(stream):
            for bits, counts in zip(parts, total, strict=True):
                counts += np.bincount(gather(fps, bits).astype(np.int64), minlength=len(counts))
        flat = np.concatenate(total)
        cell = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(flat[cell])], ["cell", "n"])

    sums = distinct.mapInArrow(giving_back(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    sizes = [1 << len(bits) for bits in parts]
    flat = np.zeros(sum(sizes), np.int64)
    for cell, n in sums.collect():  # 2 ** 11 rows for each part at most
        flat[cell] = n
    return np.split(flat, np.cumsum(sizes)[:-1])


def near_counts(counts: np.ndarray) -> np.ndarray:
    """[value, e]: fingerprints whose part differs from ``value`` in exactly e bits, e up to 2."""
    width, values = len(counts).bit_length() - 1, np.arange(len(counts))
    out = np.zeros((len(counts), MAX_THRESHOLD + 1))
    out[:, 0] = counts
    for i in range(width):
        out[:, 1] += counts[values ^ (1 << i)]
        for j in range(i):
            out[:, 2] += counts[values ^ (1 << i) ^ (1 << j)]
    return out


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """Thresholds [query, block] with the given sum and the least summed cost.

    ``costs[query, block, t + 1]`` is the cost of threshold t in -1..MAX_THRESHOLD.
    """
    queries, m, options = costs.shape
    shift = total + m  # sum of (t + 1)
    best = np.full((queries, shift + 1), np.inf)
    best[:, 0] = 0
    picks = np.zeros((m, queries, shift + 1), np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for t in range(min(options, shift + 1)):
            tried = best[:, : shift + 1 - t] + costs[:, i, t : t + 1]
            better = tried < new[:, t:]
            new[:, t:][better] = tried[better]
            picks[i][:, t:][better] = t
        best = new
    out, state, rows = np.zeros((queries, m), np.int8), np.full(queries, shift), np.arange(queries)
    for i in reversed(range(m)):
        out[:, i] = picks[i][rows, state]
        state = state - out[:, i]
    return out - 1


class Plan:
    """Blocks, their estimators and the probes that follow from them."""

    def __init__(self, blocks: list[list[int]], near: list[list[np.ndarray]], n: int, radius: int):
        self.blocks, self.near, self.n, self.radius = blocks, near, max(n, 1), radius

    @staticmethod
    def parts(block: list[int]) -> list[list[int]]:
        k = -(-len(block) // PART_BITS)
        return [block[len(block) * i // k : len(block) * (i + 1) // k] for i in range(k)]

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """Estimated cost of each threshold: parts of a block are taken as independent."""
        out = np.zeros((len(fps), len(self.blocks), MAX_THRESHOLD + 2))
        for i, block in enumerate(self.blocks):
            exact = np.zeros((len(fps), MAX_THRESHOLD + 1))
            exact[:, 0] = self.n
            for bits, near in zip(self.parts(block), self.near[i], strict=True):
                share = near[gather(fps, bits).astype(np.int64)] / self.n
                exact = np.stack([sum(exact[:, a] * share[:, e - a] for a in range(e + 1)) for e in range(MAX_THRESHOLD + 1)], axis=1)
            for t in range(MAX_THRESHOLD + 1):
                out[:, i, t + 1] = exact[:, : t + 1].sum(axis=1) + PROBE_COST * ball(len(block), t)
        return out

    def key(self, i: int, values: np.ndarray) -> np.ndarray:
        """Block number and value as one long; a block is narrower than 58 bits."""
        return ((np.uint64(i) << np.uint64(58)) | values).view(np.int64)

    def index(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, row numbers): each fingerprint under its own value in every block."""
        for i, block in enumerate(self.blocks):
            yield self.key(i, gather(fps, block)), np.arange(len(fps))

    def probes(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, row numbers): the values within each fingerprint's thresholds."""
        thresholds = allocate(self.costs(fps), self.radius - len(self.blocks) + 1)
        for i, block in enumerate(self.blocks):
            values, t = gather(fps, block), thresholds[:, i]
            masks = [(0, 0)] + [(1, 1 << a) for a in range(len(block))]
            masks += [(2, 1 << a | 1 << b) for a in range(len(block)) for b in range(a)] if (t >= 2).any() else []
            for least, mask in masks:
                rows = np.flatnonzero(t >= least)
                if len(rows):
                    yield self.key(i, values[rows] ^ np.uint64(mask)), rows


def plan(distinct: DataFrame, n: int, radius: int = RADIUS) -> Plan:
    """Blocks and estimators from statistics of all fingerprints; at most 2 ** 11 counts a part reach the driver."""
    blocks = correlated_blocks(bit_sums(distinct), n, block_count(n, radius))
    parts = [Plan.parts(block) for block in blocks]
    near = iter([near_counts(c) for c in part_counts(distinct, [bits for own in parts for bits in own])])
    return Plan(blocks, [[next(near) for _ in own] for own in parts], n, radius)


# ---- links and classes


def _keyed(nodes: DataFrame, made: Plan, which: str, rest: list[str]) -> DataFrame:
    """(key, fp, rest) of each of ``nodes`` under its probes or its index values."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, 1 << 14):
                some = batch.slice(at, 1 << 14)
                for keys, k in getattr(made, which)(some.column(0).to_numpy().view(np.uint64)):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *(c.take(pa.array(k)) for c in some.columns)], ["key", "fp", *rest])

    return nodes.select("fp", *rest).mapInArrow(giving_back(run), ", ".join(f"{n} long" for n in ("key", "fp", *rest)))


def _near(a: str, b: str, words: list[str], limit: int) -> Column:
    """Whether at most ``limit`` bits of two fingerprints differ, over all their words."""
    bits = [F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in words]
    return sum(bits[1:], bits[0]) <= limit


def first_links(nodes: DataFrame, made: Plan, words: list[str], limit: int) -> DataFrame:
    """(a, b), a > b: links of fingerprints to three under each of their block values: the least, the greatest and one by hash.

    At most three rows for each fingerprint and block.
    """
    rest = [w for w in words if w != "fp"] + ["node"]
    index = _keyed(nodes, made, "index", rest)
    own = F.struct("node", *words)
    hubs = index.groupBy("key").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.min(F.struct(F.xxhash64("node").alias("h"), own.alias("own"))).alias("some"))
    hubs = hubs.select("key", F.explode(F.array_distinct(F.array("low", "high", "some.own"))).alias("hub")).select("key", "hub.*")
    near = _near("i", "h", words, limit)
    met = index.alias("i").join(hubs.alias("h").hint("merge"), (F.col("i.key") == F.col("h.key")) & (F.col("i.node") != F.col("h.node")) & near)
    return met.select(F.greatest("i.node", "h.node").alias("a"), F.least("i.node", "h.node").alias("b"))


def links(nodes: DataFrame, made: Plan, words: list[str], limit: int) -> DataFrame:
    """(a, b), a > b: first classes with fingerprints within the limit, of ``nodes`` (node, fp, further words, first).

    A hot key is split by the skew handling of the sort-merge join; the checks on all words and on the
    classes are part of the join, so that unverified candidates are never written.
    """
    rest = [w for w in words if w != "fp"] + ["node", "first"]
    probes, index = _keyed(nodes, made, "probes", rest).alias("p"), _keyed(nodes, made, "index", rest).alias("i").hint("merge")
    # Probes find every neighbour of theirs, so that one direction is enough.
    pair = (F.col("p.key") == F.col("i.key")) & (F.col("p.node") > F.col("i.node")) & (F.col("p.first") != F.col("i.first"))
    met = probes.join(index, pair & _near("p", "i", ["fp"], made.radius) & _near("p", "i", words, limit))
    return met.select(F.greatest("p.first", "i.first").alias("a"), F.least("p.first", "i.first").alias("b"))


def forest(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: each task keeps a spanning forest of its own edges."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        def out() -> pa.RecordBatch:
            kept = [(x, root(x)) for x in list(parent) if parent[x] != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([y for _, y in kept], pa.int64())], ["a", "b"])

        for a, b in batches(stream):
            for x, y in zip(map(root, a), map(root, b), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > 1 << 19:  # memory stays bounded
                yield out()
        yield out()

    return edges.mapInArrow(giving_back(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Large-star and small-star rounds on edges (a > b), each cut in the shared folder, until the
    edges are stars. A round never has more edges than the one before it.
    """
    edges = cut(forest(edges).distinct())
    size = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    state = edges.agg(size.alias("s")).first()["s"]
    while state["n"]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written apart, so that the join may split a hub's edges (it cannot share the aggregate's shuffle).
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.filter("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").filter("a <> b").distinct())
        now = edges.agg(size.alias("s")).first()["s"]
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def classes(prints: DataFrame, radius: int = RADIUS, limit: int | None = None) -> DataFrame:
    """(words of the fingerprint, copies, component) for each distinct fingerprint of ``prints`` (fp, further words).

    Links have at most ``radius`` different bits in fp and ``limit`` in all words. Components are
    named by a node of theirs.
    """
    words = prints.columns
    limit = radius if limit is None else limit
    node = F.col("fp") if len(words) == 1 else F.xxhash64(*words)
    nodes = cut(prints.groupBy(*words).agg(F.count("*").alias("copies")).withColumn("node", node))
    made = plan(nodes.select("fp", "node"), nodes.count(), radius)
    first = components(first_links(nodes, made, words, limit))
    named = nodes.join(first.withColumnRenamed("component", "first").hint("merge"), "node", "left")
    nodes = cut(named.select(*words, "copies", "node", F.coalesce("first", "node").alias("first")))
    more = components(links(nodes, made, words, limit)).withColumnRenamed("node", "first")
    return nodes.join(more.hint("merge"), "first", "left").select(*words, "copies", F.coalesce("component", "first").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, copies, component_id) for each row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, ``copies`` the rows of that
    fingerprint. Extra columns of ``docs`` are ignored.
    """
    prints = cut(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), size).drop("text"))
    known = cut(classes(prints.select("fp"), radius))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(known.hint("merge"), "fp")
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    known = cut(known.join(ids.hint("merge"), "component").select("fp", "copies", "component_id"))
    return prints.join(known.hint("merge"), "fp").select("doc_id", "fp", "copies", "component_id")


def most_bits(similarity: float, bits: int) -> int:
    """The most differing bits at which a fingerprint's estimate of the similarity (Jaccard's, of shingles) is as asked."""
    overlap = 2 * similarity / (1 + similarity)
    return int(bits * math.acos(overlap) / math.pi)


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, radius: int = STAGE_RADIUS, size: int = STAGE_SHINGLE) -> DataFrame:
    """One row of ``docs`` for each class of similar texts, with all its columns.

    The row of the smallest doc_id stays (a null one only where the class has no other); of rows that
    repeat that id with the same fingerprint the least in order of the columns.
    """
    prints = cut(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), size, WIDE).drop("text"))
    words = prints.columns[1:]
    docs, back = set_aside(docs, (*words, *(f"k_{w}" for w in words), "k_id", "k_alone"))
    known = classes(prints.select(*words), radius, most_bits(similarity, BITS * WIDE)).drop("copies")
    found = prints.groupBy("doc_id", *words).agg(F.count("*").alias("rows"))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *words, "rows")).alias("best")
    keep = found.join(known.hint("merge"), words).groupBy("component").agg(best).select("best.*")
    texts = found.groupBy("doc_id").agg(F.sum("rows").alias("all"))
    keep = cut(keep.join(texts.hint("merge"), "doc_id", "left").select("doc_id", *words, F.col("doc_id").isNotNull() & (F.col("all") == 1)).toDF("k_id", *(f"k_{w}" for w in words), "k_alone"))
    # Always a shuffle join: the list of what stays grows with the documents.
    alone = keep.filter("k_alone").select("k_id").hint("merge")
    out = docs.join(alone, F.col("doc_id") == F.col("k_id")).drop("k_id")
    others = keep.filter("not k_alone")
    if others.limit(1).count():
        # Ids that several rows have, and null: the rows are known by their fingerprints.
        ids = others.select("k_id").distinct().hint("merge")
        rows = docs.filter("doc_id is not null").join(ids, F.col("doc_id") == F.col("k_id"), "left_semi").unionByName(docs.filter("doc_id is null"))
        same = F.col("doc_id").eqNullSafe(F.col("k_id"))
        for w in words:
            same &= F.col(w) == F.col(f"k_{w}")
        met = fingerprints(rows, size, WIDE).join(others.hint("merge"), same)
        out = out.unionByName(met.groupBy("doc_id", *words).agg(F.min(F.struct(*docs.columns)).alias("least")).select("least.*"))
    return out.select(*back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash_near_dedup": query}
ORACLE_SQL: dict[str, str] = {}
