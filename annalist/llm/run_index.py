"""Removal of repeated stretches of bytes, by run-length indexes of the places where texts may agree.

A window is a stretch of ``WINDOW`` bytes; what windows with a second occurrence cover is removed. No
index of the whole corpus fits a process, so windows that can be equal are brought together first.
The least hash among a window's stretches of ``ANCHOR`` bytes is its anchor, which follows from its
bytes alone: equal windows have equal anchors. Successive windows of a text with one anchor are a
block, known by the hashes of its anchor and of its bytes. Blocks that occur twice repeat whole;
anchors of one block only cannot repeat elsewhere. What is left, different blocks with one anchor,
is brought together with its bytes, once for each different block, and indexed bucket by bucket:

* the Burrows-Wheeler transform of a bucket's blocks is cut into runs of equal bytes, and the place
  and common length of the suffixes at both ends of each run are sampled;
* within a run, going back one byte in the text adds one byte to what a suffix and its neighbour in
  the order have in common. So matching statistics (the longest match of each place with any other)
  are streamed over the text from the samples: one less at each byte until the next sampled end;
* where they reach ``WINDOW``, a window has a second occurrence.

An anchor with more than ``HOT`` different blocks, such as that of a line found everywhere, is split:
its windows go to two halves by how far before the anchor they begin; all windows of a half share a
longer middle, whose hash is the key of the half. Halving ends at single windows, which are equal
if their keys are.

Hashes are of 64 bits, two to a block; bytes are compared by the index only where they differ.

Defined cases: a null text is empty, has no bytes and the digest of nothing; texts under ``WINDOW``
bytes stay whole; texts of any length are read whole, in pieces; repeated rows are occurrences of
each other and are each reported; a null doc_id is kept; empty tables give an empty result; other
columns are ignored by the report and kept by the filter. ``docs`` is read several times and its
rows are known by their places, so it must be a scan or a written table, not a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import cut, flat_bytes, giving_back, set_aside, table, utf8
from annalist.llm.suffixes import Suffixes

WINDOW, ANCHOR = 400, 128
#: Different blocks of an anchor beyond which it is split.
HOT = 1024
#: Windows that are hashed at once, and bytes of an index.
PIECE, BUCKET = 1 << 20, 1 << 19

_MULTIPLIER = 0x9E3779B97F4A7C15
_PLACE = np.uint64(22)  # bits of a place in a piece


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_NUMBER = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd number and of its inverse, modulo 2 ** 64."""
    both = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        both.append(np.cumprod(factors))
    return both[0], both[1]


def blocks(data: np.ndarray, bounds: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, anchor's hash, block's hash, first byte in the text, windows, place of the anchor in the block) of each block.

    ``data`` holds the texts one after another, text k in data[bounds[k]:bounds[k + 1]].
    """
    found = []
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    across = window - anchor + 1
    for low in range(0, max(0, len(data) - window + 1), PIECE):
        part = data[low : low + PIECE + window - 1]
        n = len(part) - window + 1
        up, down = _powers(PIECE + window)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_NUMBER[part] * up[: len(part)], out=sums[1:])
        own = _mixed((sums[anchor:] - sums[:-anchor]) * down[: len(part) - anchor + 1])
        # The least hash of each window, the first of equal ones: least from both sides of fixed marks.
        named = own >> _PLACE << _PLACE | np.arange(len(own), dtype=np.uint64)
        padded = np.append(named, np.full(-len(named) % across, ~np.uint64(0))).reshape(-1, across)
        ahead = np.minimum.accumulate(padded, 1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[across - 1 : across - 1 + n]) & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
        text = owner[low : low + n]
        whole = text == owner[low + window - 1 : low + window - 1 + n]
        edge = np.ones(n + 1, bool)
        edge[1:n] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
        at = np.flatnonzero(edge)
        first, windows = at[:-1], np.diff(at)
        first, windows = first[whole[first]], windows[whole[first]]
        end = first + windows + window - 1
        offset = place[first] - first
        content = (sums[end] - sums[first]) * down[first] + windows.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + offset.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        found.append((text[first], own[place[first]].view(np.int64), _mixed(content).view(np.int64), first + low - bounds[text[first]], windows, offset))
    if not found:
        return (np.zeros(0, np.int64),) * 6
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def long_matches(texts: list[bytes], least: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each text the ranges (first, one past the last) of places from which ``least`` bytes also start elsewhere in the texts."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    n = len(data)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    left = (ends[owner] - np.arange(n)).astype(np.int32)
    symbol = data.astype(np.int16) + 1
    symbol[ends] = 0
    # Seven symbols of nine bits: bytes and the end of a text.
    key, span = np.zeros(n, np.int64), 7
    padded = np.append(symbol, np.zeros(span, np.int16))
    for k in range(span):
        key = key << 9 | np.where(left >= k, padded[k : k + n], 0)
    found = Suffixes(key, left, span)
    order = found.order[len(texts) :]  # the ends of the texts come first
    if not len(order):
        return out
    # Runs of the transform; the byte before a text is like no other.
    before = symbol[order - 1].astype(np.int64)
    before[order == 0] = 0
    cut_ = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1
    upper, lower = order[cut_ - 1], order[cut_]
    shared = found.common(upper, lower).astype(np.int64)
    live = np.arange(len(cut_))
    for _ in range(span - 1):
        a, b = upper[live] + shared[live], lower[live] + shared[live]
        live = live[(symbol[a] == symbol[b]) & (symbol[a] > 0)]
        shared[live] += 1
    # Samples at the first and last suffix of each run; the outermost have nothing beyond them.
    marked = np.zeros(n, bool)
    places = np.arange(n)
    for ends_of_runs, outermost in ((lower, order[0]), (upper, order[-1])):
        sampled, common = np.zeros(n, bool), np.zeros(n, np.int64)
        sampled[ends_of_runs] = sampled[outermost] = True
        common[ends_of_runs] = shared
        last = np.maximum.accumulate(np.where(sampled, places, 0))
        marked |= common[last] - (places - last) >= least
    marked[ends] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.view(np.int8), [0]])))
    begins = ends - sizes
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        text = owner[low]
        out[text].append((low - int(begins[text]), high - int(begins[text])))
    return out


# ---- the passes

_BLOCKS = "row long, anchor long, block long, windows int, offset int, starts array<int>"
_FOUND = "anchor long, block long, low int, high int"


def _blocks(texts: DataFrame) -> DataFrame:
    """The blocks of ``texts`` (row, text as bytes); equal ones of a text are one row with all their starts."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            data, bounds = flat_bytes(batch.column(1))
            text, anchor, block, start, windows, offset = blocks(data, bounds)
            order = np.lexsort((start, block, anchor, text))
            text, anchor, block, start, windows, offset = (x[order] for x in (text, anchor, block, start, windows, offset))
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])
            first = np.flatnonzero(new)
            starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(text)).astype(np.int32)), pa.array(start.astype(np.int32)))
            columns = [batch.column(0).take(pa.array(text[first])), pa.array(anchor[first]), pa.array(block[first]), pa.array(windows[first].astype(np.int32)), pa.array(offset[first].astype(np.int32)), starts]
            yield pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in _BLOCKS.split(", ")])

    return texts.mapInArrow(giving_back(run), _BLOCKS)


def _with_bytes(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``wanted`` (row, start, size and others) with the ``bytes`` of that stretch of the row's text."""
    other = [c for c in wanted.columns if c != "row"]
    each = wanted.groupBy("row").agg(F.collect_list(F.struct(*other)).alias("wanted")).join(texts, "row")
    each = each.select("text", F.explode("wanted").alias("w"))
    return each.select(*(F.col(f"w.{c}").alias(c) for c in other), F.expr("substring(text, w.start + 1, w.size)").alias("bytes"))


def _halves(nodes: DataFrame) -> DataFrame:
    """Both halves of each node, with the windows that fall into them and the key of what these share.

    ``low`` and ``high`` bound where a node's windows may begin, counted from the anchor; ``base`` is its
    first window in the block, ``offset`` the anchor's place in ``bytes``.
    """
    middle = F.expr("low + (high - low) div 2")
    sides = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
    each = nodes.filter("low < high").withColumn("half", F.explode(sides))
    each = each.withColumn("first", F.greatest(-F.col("offset"), F.col("half.low"))).withColumn("last", F.least(-F.col("offset") + F.col("windows") - 1, F.col("half.high")))
    each = each.filter("first <= last").withColumn("skip", F.col("first") + F.col("offset"))
    middle_bytes = F.expr(f"substring(bytes, offset + half.high + 1, half.low - half.high + {WINDOW})")
    return each.select(
        "anchor",
        "block",
        F.xxhash64("key", "half.high", middle_bytes).alias("key"),
        F.col("half.low").alias("low"),
        F.col("half.high").alias("high"),
        (F.col("base") + F.col("skip")).alias("base"),
        (F.col("last") - F.col("first") + 1).cast("int").alias("windows"),
        (F.col("offset") - F.col("skip")).cast("int").alias("offset"),
        "decided",
        F.expr(f"substring(bytes, skip + 1, last - first + {WINDOW})").alias("bytes"),
    )


def _several(nodes: DataFrame, key: str, over: int) -> DataFrame:
    """The keys that more than ``over`` rows have."""
    return nodes.groupBy(key).agg(F.count("*").alias("kinds")).filter(F.col("kinds") > over).select(key)


def _split(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(nodes of keys that are not hot, what was found on the way)."""
    ready, found = [], []
    while True:
        hot = cut(_several(nodes, "key", HOT))
        if hot.isEmpty():
            return [*ready, nodes], found
        ready.append(nodes.join(hot, "key", "left_anti"))
        halves = cut(_halves(nodes.join(hot, "key", "left_semi")).withColumn("content", F.xxhash64("bytes", "offset")))
        alike = halves.groupBy("key", "content").agg(F.count("*").alias("n"), F.min_by(F.struct(*(c for c in halves.columns if c not in ("key", "content"))), F.struct("decided", "anchor", "block", "base")).alias("one"))
        alike = cut(alike)
        found.append(halves.filter("not decided").join(alike.filter("n > 1").select("key", "content"), ["key", "content"]).select("anchor", "block", F.col("base").alias("low"), (F.col("base") + F.col("windows")).alias("high")))
        own = alike.select("key", "n", "one.*").withColumn("decided", F.expr("decided or n > 1")).drop("n")
        nodes = cut(own.join(_several(own, "key", 1), "key"))


def _indexed(nodes: DataFrame) -> DataFrame:
    """(anchor, block, low, high): windows of undecided nodes that occur twice among the nodes of one bucket."""
    size = nodes.agg(F.sum(F.length("bytes"))).first()[0] or 0
    count = max(1, size // BUCKET)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(a, b, base + x, base + y) for (a, b, base, decided, _), ranges in zip(held, long_matches([h[4] for h in held]), strict=True) if not decided for x, y in ranges]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "block", "low", "high"])

        for batch in stream:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from out()
                    now, held = bucket, []
                held.append(row)
        yield from out()

    dealt = nodes.select(F.pmod(F.xxhash64("key"), F.lit(count)).cast("int").alias("bucket"), "anchor", "block", "base", "decided", "bytes")
    return dealt.repartition(count, "bucket").sortWithinPartitions("bucket").mapInArrow(giving_back(run), _FOUND)


def repeated(texts: DataFrame) -> DataFrame:
    """(row, spans): where windows that occur twice begin in each of ``texts`` (row, text as bytes) that has any: array of (low, high), high excluded."""
    every = cut(_blocks(texts))
    kinds = every.groupBy("anchor", "block").agg(F.sum(F.size("starts")).alias("n"), F.min(F.struct("row", F.element_at("starts", 1).alias("start"), "windows", "offset")).alias("one"))
    kinds = cut(kinds)
    twice = kinds.filter("n > 1").select("anchor", "block", F.lit(0).alias("low"), F.col("one.windows").alias("high"))
    met = kinds.join(_several(kinds, "anchor", 1), "anchor")
    wanted = met.select("one.row", "anchor", "block", "one.start", (F.col("one.windows") + WINDOW - 1).alias("size"), "one.windows", "one.offset", (F.col("n") > 1).alias("decided"))
    first, last = F.lit(ANCHOR - WINDOW), F.lit(0)
    nodes = _with_bytes(wanted, texts).select("anchor", "block", F.col("anchor").alias("key"), first.alias("low"), last.alias("high"), F.lit(0).alias("base"), "windows", "offset", "decided", "bytes")
    ready, found = _split(cut(nodes))
    whole = ready[0]
    for more in ready[1:]:
        whole = whole.unionByName(more)
    # A key without an undecided block, or with one block only, has nothing left to find.
    for part in [*found, cut(_indexed(whole))]:
        twice = twice.unionByName(part)
    hits = every.join(twice, ["anchor", "block"]).select("row", F.explode("starts").alias("start"), "low", "high")
    return hits.groupBy("row").agg(F.collect_list(F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))).alias("spans"))


def removed_runs(low: np.ndarray, high: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the maximal runs of bytes that windows beginning in the ranges [low, high) cover."""
    order = np.argsort(low, kind="stable")
    low, end = low[order], np.maximum.accumulate(high[order] + window - 1)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > end[:-1]
    first = np.flatnonzero(new)
    return low[first], end[np.append(first[1:], len(low)) - 1]


def _apart(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Each row's spans as removed runs."""
    for spans in column:
        if spans.is_valid and len(spans.values):
            low, high = (spans.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            yield removed_runs(low, high)
        else:
            yield None


def _rest(text: bytes, runs: tuple[np.ndarray, np.ndarray] | None) -> bytes:
    if runs is None:
        return text
    begins, ends = (x.tolist() for x in runs)
    return b"".join(text[a:b] for a, b in zip([0, *ends], [*begins, len(text)], strict=True))


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _numbered(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), *(c for c in docs.columns if c != "text"), text.alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs`` (doc_id, text)."""
    rows = _numbered(docs.select(F.col("doc_id").cast("long"), "text"), F.coalesce(utf8(F.col("text")), F.lit(b"")))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for text, runs in zip(batch.column(1).to_pylist(), _apart(batch.column(2)), strict=True):
                rest = _rest(text, runs)
                out.append((len(text), len(text) - len(rest), 0 if runs is None else len(runs[0]), sha256(rest).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(x)) for x in zip(*out, strict=True))], [field.split()[0] for field in _REPORT.split(", ")])

    return rows.join(repeated(rows.select("row", "text")), "row", "left").select("doc_id", "text", "spans").mapInArrow(giving_back(run), _REPORT)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with its texts cut; what is left of characters whose bytes went in part is dropped, nulls stay null."""
    plain, back = set_aside(docs, ("row", "spans"))
    rows = _numbered(plain, utf8(F.col("text")))
    met = rows.join(repeated(rows.select("row", F.coalesce("text", F.lit(b"")).alias("text"))), "row", "left").select(*plain.columns, "spans")
    at = plain.columns.index("text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [None if text is None else _rest(text, runs).decode(errors="ignore") for text, runs in zip(batch.column(at).to_pylist(), _apart(batch.column(len(batch.columns) - 1)), strict=True)]
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return met.mapInArrow(giving_back(run), plain.schema).select(*back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from each of all documents."""
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op13_suffix_array_dedup": query}
ORACLE_SQL = {
    "op13_suffix_array_dedup": """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select r, i, md5(substr(x, 2 * i + 1, 800)) as h from (select r, x, unnest(range(0, cast(length(x) / 2 as bigint) - 399)) as i from d where length(x) >= 800)),
twice as (select r, i from w where h in (select h from w group by h having count(*) > 1)),
begun as (select r, i, case when i <= lag(i) over (partition by r order by i) + 400 then 0 else 1 end as new from twice),
numbered as (select r, i, sum(new) over (partition by r order by i) as k from begun),
runs as (select r, k, min(i) as a, max(i) + 400 as b from numbered group by r, k),
gaps as (select r, k, a, b, lag(b, 1, 0) over (partition by r order by k) as since, lead(k) over (partition by r order by k) is null as final from runs),
own as (
  select d.r, count(*) as n_spans, sum(b - a) as n_removed,
         string_agg(substr(x, 2 * since + 1, 2 * (a - since)) || case when final then substr(x, 2 * b + 1) else '' end, '' order by k) as rest
  from gaps join d on gaps.r = d.r group by d.r)
select doc_id, cast(length(x) / 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(rest, x))) as kept_sha256
from d left join own on d.r = own.r"""
}
