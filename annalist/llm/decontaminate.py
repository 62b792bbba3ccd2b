"""Benchmark decontamination: a broadcast hash set of normalised windows, probed by all texts.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. An item's windows
are its runs of ``width`` words; an item of fewer words, but not none, is one window. Windows are
held as sorted hashes of word numbers and each hit is verified word by word. A set of windows
larger than ``BLOCK`` is applied in blocks, whose hits are then united, so that what is broadcast
stays bounded whatever the benchmark's size.

Defined cases: a null or wordless text has no hits and is not contaminated; a null or wordless item
has no window; repeated document rows are each judged; a window that several items share counts for
each of them; an item_id that occurs twice counts once; items without an id hit like others and count as
one, left out of the digest; empty tables give an empty result or no hits; other columns are kept by
the filters and ignored by the report.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import batches, cut, set_aside, table, utf8

WIDTH = 13
#: Words of the windows that are broadcast at once: some 100 MB in a Python worker at most.
BLOCK = 1 << 20
#: A document is contaminated if 1 / SHARE of its words at least are hit.
SHARE = 20

#: Bytes: ASCII letters are lower-cased, digits and bytes of other characters kept, the rest are gaps.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    """The normalised words of a text."""
    return (text or b"").translate(FOLD).split()


def _hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word numbers."""
    out = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ ids[k : len(ids) - width + 1 + k].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


class Windows:
    """The windows of a bounded set of items, for probing."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int = WIDTH):
        self.number: dict[bytes, int] = {}
        by: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, found in items:
            ids = [self.number.setdefault(word, len(self.number) + 1) for word in found]
            n = min(width, len(ids))
            for k in range(len(ids) - n + 1) if n else ():
                by.setdefault(n, {}).setdefault(tuple(ids[k : k + n]), set()).add(item)
        self.sets = []
        for n, windows in sorted(by.items()):
            grams = np.array(list(windows), dtype=np.int64).reshape(-1, n)
            hashes = np.array([_hashes(g, n)[0] for g in grams], dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            owners = [_in_order(x) for x in windows.values()]
            self.sets.append((n, hashes[order], grams[order], [owners[k] for k in order]))

    def hits(self, text: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """(mask of words inside an occurrence of a window, items that occur)."""
        mask, items = np.zeros(len(text), bool), set()
        get = self.number.get
        ids = np.fromiter((get(word, 0) for word in text), np.int64, len(text))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, hashes, grams, owners in self.sets:
            if len(text) < n:
                continue
            starts = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(starts):
                continue
            own = _hashes(ids, n)[starts]
            at = np.searchsorted(hashes, own)
            last = np.searchsorted(hashes, own, side="right")
            for k in np.flatnonzero(last > at):
                for j in range(at[k], last[k]):  # several only if hashes collide
                    if (grams[j] == ids[starts[k] : starts[k] + n]).all():
                        mask[starts[k] : starts[k] + n] = True
                        items.update(owners[j])
        return mask, items


def _blocks(benchmark: DataFrame, width: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of at most BLOCK words; an item beyond that is cut with an overlap."""
    block, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), utf8(F.col("text"))).filter("text is not null")
    for item, text in rows.toLocalIterator():
        found = words(text)
        step = max(1, BLOCK - width + 1)
        for k in range(0, max(1, len(found) - width + 1), step):
            piece = found[k : k + BLOCK]
            if held and held + len(piece) > BLOCK:
                yield block
                block, held = [], 0
            block.append((item, piece))
            held += len(piece)
    if block:
        yield block


def _in_order(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is None, x or ""))


def _verdict(n: int, hit: int, items: list[str | None]) -> tuple:
    return n, hit, len(items), sha256(",".join(x for x in items if x is not None).encode()).hexdigest(), hit > 0 and SHARE * hit >= n


_SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_NAMES = [field.split()[0] for field in _SCHEMA.split(", ")]


def judged(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the counts and the verdict on each row; a column with such a name is replaced."""
    spark = docs.sparkSession
    docs = docs.drop(*_NAMES)
    at, out = docs.columns.index("text"), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema.fields)}, {_SCHEMA}"
    blocks = _blocks(benchmark, width)
    first, second = next(blocks, []), next(blocks, None)

    def judge(sent):
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = sent.value
            for batch in stream:
                if batch.num_rows:
                    rows = []
                    for text in batch.column(at).cast(pa.binary()).to_pylist():
                        found = words(text)
                        mask, items = windows.hits(found)
                        rows.append(_verdict(len(found), int(mask.sum()), _in_order(items)))
                    columns = [pa.array(list(values)) for values in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *_NAMES])

        return run

    if second is None:
        return docs.mapInArrow(judge(spark.sparkContext.broadcast(Windows(first, width))), out)
    plain, back = set_aside(docs, ("row",))
    return _united(plain, chain([first, second], blocks), width).select(*back, *_NAMES)


def spans(numbered: DataFrame, sent, first: bool) -> DataFrame:
    """(row, n_words, starts, ends, items): hits of one block; the first has every row."""
    schema = "row long, n_words long, starts array<long>, ends array<long>, items array<string>"

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value
        for rows, texts in batches(stream):
            out = []
            for row, text in zip(rows, texts, strict=True):
                found = words(text)
                mask, items = windows.hits(found)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                if first or len(edges):
                    out.append((row, len(found), edges[::2].tolist(), edges[1::2].tolist(), _in_order(items)))
            if out:
                types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True), types, strict=True)], ["row", "n_words", "starts", "ends", "items"])

    return numbered.select("row", utf8(F.col("text"))).mapInArrow(run, schema)


def _united(docs: DataFrame, blocks: Iterator, width: int) -> DataFrame:
    """The same as one block would give, from as many passes as there are blocks."""
    spark, found = docs.sparkSession, None
    numbered = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    for block in blocks:
        sent = spark.sparkContext.broadcast(Windows(block, width))
        own = cut(spans(numbered, sent, found is None))
        sent.destroy()
        found = own if found is None else found.unionByName(own)

    def unite(key, part):
        n = max(part.column("n_words").to_pylist())
        mask, items = np.zeros(n, bool), set()
        for starts, ends, own in zip(*(part.column(c).to_pylist() for c in ("starts", "ends", "items")), strict=True):
            for a, b in zip(starts, ends, strict=True):
                mask[a:b] = True
            items.update(own)
        values = [key[0].as_py(), *_verdict(n, int(mask.sum()), _in_order(items))]
        return pa.table({name: [value] for name, value in zip(["row", *_NAMES], values, strict=True)})

    verdicts = found.groupBy("row").applyInArrow(unite, f"row long, {_SCHEMA}")
    return numbered.join(verdicts, "row").select(*docs.columns, *_NAMES)


def removed(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the contaminated rows; the others stay as they are."""
    plain, back = set_aside(docs, (*_NAMES, "row"))
    return judged(plain, benchmark, width).filter("not contaminated").select(*back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, table(spark, sf_dir, "benchmark")).drop("text")


QUERIES = {"op6_decontaminate": query}
ORACLE_SQL = {
    "op6_decontaminate": r"""
with d as (
  select doc_id, row_number() over () as r,
         list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
b as (
  select cast(item_id as varchar) as item,
         list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
bw as (
  select distinct item, least(13, len(w)) as n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') as g
  from (select item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as k from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (
  select r, k, n, array_to_string(w[k : k + n - 1], ' ') as g
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from d, lens where len(w) >= n)),
hits as (select dw.r, dw.k, dw.n, bw.item from dw join bw on dw.n = bw.n and dw.g = bw.g),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from hits) group by r),
own as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from hits) group by r)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join pos on d.r = pos.r left join own on d.r = own.r"""
}
