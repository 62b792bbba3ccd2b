"""Periodic runs: maximal repetitions of words, by a suffix tree's branching tandem repeats.

The words of a text are numbered and its suffixes sorted; the lengths that neighbours in that order
have in common give the suffix tree, here with two children at each node (a node of more children
is a chain of nodes of equal depth). A stretch of period q that ends somewhere holds exactly one
tandem repeat of q words twice that cannot be moved right: its halves part in a node of depth q. So
for each node the smaller half of its leaves is listed, and a leaf whose partner, q words further
or back, lies in the other half is such a branching repeat; each leaf is listed a logarithmic
number of times. A repeat is rotated to the left as long as words agree, which gives the whole run;
runs found with several periods keep the smallest. Only texts in which 16 words occur twice can
hold a run of 24 words and three periods; the others are passed over. Texts are taken in groups of
about ``GROUP`` words, whatever the batches.

Defined cases: a null, empty or wordless text has no words, no runs and the digests of nothing; a
text of any length is read whole; repeated rows are each reported; rows with a null doc_id are not
changed before the search; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import batches, giving_back, table, utf8
from annalist.llm.suffixes import Suffixes

#: A run has this many words and this many periods at least.
LEAST, TIMES = 24, 3
#: Words that are searched at once, and leaves that are looked at at once.
GROUP, LEAVES = 1 << 18, 1 << 20
#: What every run repeats within its text, whatever its period: min over q of max(24, 3 q) - q.
SURE = min(max(LEAST, TIMES * q) - q for q in range(1, LEAST))

_MIX = np.uint64(0x9E3779B97F4A7C15)
Run = tuple[int, int, int]  #: start, length, period


def extended(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the tail made periodic, in one of ten texts."""
    h = 1 if doc_id is None else crc32(b"%d" % doc_id)
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def repeating(ids: np.ndarray, owner: np.ndarray, texts: int, width: int = SURE) -> np.ndarray:
    """Which texts may hold a stretch of ``width`` words twice; ``owner`` is the text of each word."""
    out = np.zeros(texts, bool)
    if len(ids) < width:
        return out
    h = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        h = (h ^ ids[k : len(h) + k].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    own = owner[: len(h)]
    inside = np.flatnonzero(own == owner[width - 1 :])
    h = (h[inside] ^ own[inside].astype(np.uint64)) * _MIX
    order = np.argsort(h)
    twice = h[order[1:]] == h[order[:-1]]
    out[own[inside[order[1:][twice]]]] = True
    return out


def tree(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node k > 0, between leaves k - 1 and k: its first leaf, and the one after its last."""
    n = len(common)
    depth = np.append(common, -1).astype(np.int64)
    depth[0] = -1
    low, high = np.arange(-1, n), np.arange(1, n + 2)
    for to, over in ((low, lambda k: depth[low[k]] > depth[k]), (high, lambda k: depth[high[k]] >= depth[k])):
        live = np.arange(1, n)
        while len(live := live[over(live)]):
            to[live] = to[to[live]]
    return low[:n], high[:n]


def branching(found: Suffixes, common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word, period) of all branching tandem repeats."""
    order, n = found.order, len(found.order)
    low, high = tree(common)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    node = np.flatnonzero(common > 0)
    # A repeat of three periods needs a text of as many words.
    node = node[TIMES * common[node].astype(np.int64) <= found.left[order[node]] + found.left[order[node - 1]] + common[node]]
    left = node - low[node] <= high[node] - node
    begin, end = np.where(left, low[node], node), np.where(left, node, high[node])
    other, stop = np.where(left, node, low[node]), np.where(left, high[node], node)
    upto = np.cumsum(end - begin)
    at = 0
    while at < len(node):
        last = max(at + 1, int(np.searchsorted(upto, upto[at] + LEAVES)))
        part = slice(at, last)
        size = (end - begin)[part]
        which = np.repeat(np.arange(at, last), size)
        leaf = order[np.arange(size.sum()) + np.repeat(begin[part] - np.cumsum(size) + size, size)].astype(np.int64)
        period = common[node[which]].astype(np.int64)
        for first, second in ((leaf, leaf + period), (leaf - period, leaf)):
            partner = second if first is leaf else first
            ok = np.flatnonzero((partner >= 0) & (partner < n))
            r = rank[partner[ok]]
            ok = ok[(r >= other[which[ok]]) & (r < stop[which[ok]])]
            yield first[ok], period[ok]
        at = last


def runs(texts: list[np.ndarray]) -> list[list[Run]]:
    """The runs of each sequence of word numbers, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[Run]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    # Words are numbered within their text, so that texts do not meet in the tree.
    every = np.concatenate([np.append(t, -1) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    left = (ends[owner] - np.arange(len(every))).astype(np.int32)
    # A closing place is its text's least and stands alone, so it has nothing in common with any.
    found = Suffixes(owner.astype(np.int64) << 32 | (every + 1), left)
    common = np.zeros(len(every), np.int32)
    common[1:] = found.common(found.order[:-1], found.order[1:])
    parts = [(*pair, found.before(pair[0], pair[0] + pair[1], pair[0] - (ends - sizes)[owner[pair[0]]])) for pair in branching(found, common)]
    first, period, more = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    start, length = first - more, more + 2 * period
    whole = np.flatnonzero(length >= np.maximum(LEAST, TIMES * period))
    start, length, period = start[whole], length[whole], period[whole]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    new = np.ones(len(by), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    for s, n, q in zip(start[new].tolist(), length[new].tolist(), period[new].tolist(), strict=True):
        text = owner[s]
        out[text].append((s - int(ends[text] - sizes[text]), n, q))
    for found_ in out:
        found_.sort(key=lambda run: (run[0], run[2]))
    return out


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_NAMES = [field.split()[0] for field in _SCHEMA.split(", ")]


def best(found: list[Run]) -> Run | None:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""
    top = None
    for run in found:  # in the order of ties
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def kept(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [word for word, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d]


def report(docs: DataFrame, change: Callable[[list[bytes], int | None], list[bytes]] = lambda words, _: words) -> DataFrame:
    """The runs of each row of ``docs`` (doc_id, text): their number, the foremost one, and the digests of all of them and of the words that are kept.

    ``change`` may alter the words of a text before the search.
    """

    def search(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        put = number.setdefault
        ids = [np.fromiter((put(word, len(number)) for word in words), np.int64, len(words)) for _, words in held]
        owner = np.repeat(np.arange(len(held)), [len(x) for x in ids])
        may = np.flatnonzero(repeating(np.concatenate(ids), owner, len(held)))
        of = dict(zip(may.tolist(), runs([ids[k] for k in may]), strict=True))
        rows = []
        for k, (doc_id, words) in enumerate(held):
            found = of.get(k, [])
            top = best(found)
            rows.append(
                (doc_id, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha256("".join("%d,%d,%d\n" % run for run in found).encode()).hexdigest(), sha256(b" ".join(kept(words, found))).hexdigest())
            )
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, list[bytes]]] = []
        size = 0
        for doc_ids, texts in batches(stream):
            for doc_id, text in zip(doc_ids, texts, strict=True):
                words = change((text or b"").split(), doc_id)
                held.append((doc_id, words))
                size += len(words) + 1
                if size >= GROUP:
                    yield search(held)
                    held, size = [], 0
        if held:
            yield search(held)

    return docs.select(F.col("doc_id").cast("long"), utf8(F.col("text")).alias("text")).mapInArrow(giving_back(run), _SCHEMA)


def collapsed(docs: DataFrame) -> DataFrame:
    """``docs`` with texts whose runs are collapsed to one period, words joined by one space; texts without runs and nulls stay as they are."""
    at = docs.columns.index("text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            texts = batch.column(at).to_pylist()
            words = [(text or "").encode().split() for text in texts]
            number: dict[bytes, int] = {}
            put = number.setdefault
            found = runs([np.fromiter((put(w, len(number)) for w in own), np.int64, len(own)) for own in words])
            out = [b" ".join(kept(own, r)).decode() if r else text for text, own, r in zip(texts, words, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(giving_back(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, of which one in ten is given a periodic tail."""
    return report(table(spark, sf_dir, "documents"), extended)


QUERIES = {"op12_periodic_runs": query}
ORACLE_SQL: dict[str, str] = {}
