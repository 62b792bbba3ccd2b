"""Byte-level BPE: encoding with a segment tree of pair ranks, and decoding.

Each match of the split pattern is merged by itself. A segment tree over its byte positions holds,
for every live position, the rank of the pair that starts there, and in its root the leftmost
least rank; a merge updates the live neighbours only, each in logarithmic time.

Defined cases: a null text is an empty one, with no ids; a text of any length is read whole (a
match of n bytes takes O(n log n)); equal texts give equal ids; repeated rows are each returned; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import batches, giving_back, table

#: Matches kept in each of a worker's two generations, and the longest that is kept.
CACHED, CACHED_LENGTH = 1 << 17, 48
#: The longest match in bytes whose tree is merged with others, and how many at once.
TREES, ROWS = 64, 4096
#: Characters of the texts, or matches of one long text, that are encoded together.
GROUP = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def by_rank(ranks: dict[bytes, int]) -> list[bytes | None]:
    """Token bytes at their ranks; None where a rank has no token."""
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match: always merge the pair of least rank, the leftmost of equals."""
    n = len(piece)
    if n == 1 or piece in ranks:
        return [ranks[piece]]
    # A node holds rank * size + position, so that the least is the leftmost of least rank.
    size = 1 << (n - 1).bit_length()
    never = size << 40
    get = ranks.get
    tree = [never] * (2 * size)
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            tree[size + i] = rank * size + i
    for k in range(size - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the next live position, and the one before

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1
            if tree[k] == value:
                return
            tree[k] = value

    def pair(i: int) -> int:
        middle = after[i]
        if middle >= n:
            return never
        rank = get(piece[i : after[middle]])
        return never if rank is None else rank * size + i

    while (least := tree[1]) < never:
        i = least & (size - 1)
        gone = after[i]
        after[i] = end = after[gone]
        if end < n:
            before[end] = i
        put(gone, never)
        put(i, pair(i))
        if (left := before[i]) >= 0:
            put(left, pair(left))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Pairs:
    """Ranks of pairs of tokens, and the segment trees of many short matches at once."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # An open-addressed table, a quarter full at most: a pair lies at its place or soon after it.
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.codes, self.ranks = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        at = self._place(pairs[:, 0])
        while len(pairs):
            free = self.codes[at] < 0
            self.codes[at[free]] = pairs[free, 0]  # of several for one place the last stays
            own = self.codes[at] == pairs[:, 0]
            self.ranks[at[own]] = pairs[own, 1]
            pairs, at = pairs[~own], (at[~own] + 1) & ((1 << self.bits) - 1)

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray, never: int) -> np.ndarray:
        """The rank of each pair; ``never`` for those that do not merge."""
        code = a << 32 | b
        at = self._place(code)
        held = self.codes[at]
        out = np.where(held == code, self.ranks[at], never)
        open_ = np.flatnonzero((held != code) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.codes[at[open_]]
            found = held == code[open_]
            out[open_[found]] = self.ranks[at[open_[found]]]
            open_ = open_[~found & (held >= 0)]
        return out

    def merge(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """The ids of matches of at most ``size`` bytes, a power of two: a row of each array is one match's tree.

        As in ``merge``, a node holds rank * size + position. In each step every match that is not
        done merges its root's pair, and updates three leaves and the paths above them.
        """
        never, rows = 1 << 40, len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, rows)
        raw = np.frombuffer(b"".join(piece.ljust(size, b"\0") for piece in pieces), np.uint8).reshape(rows, size)
        place = np.arange(size)
        ids, live = self.bytes[raw], place < n[:, None]
        after, before = np.tile(place + 1, (rows, 1)), np.tile(place - 1, (rows, 1))
        tree = np.full((rows, 2 * size), never * size)
        pair = place[:-1] < n[:, None] - 1
        first = np.full((rows, size - 1), never)
        first[pair] = self.rank(ids[:, :-1][pair], ids[:, 1:][pair], never)
        tree[:, size : 2 * size - 1] = first * size + place[:-1]
        k = size
        while k > 1:
            k //= 2
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        at = np.arange(rows)
        while len(at := at[tree[at, 1] < never * size]):
            root = tree[at, 1]
            i = root % size
            gone = after[at, i]
            end = after[at, gone]
            ids[at, i], live[at, gone], after[at, i] = root // size, False, end
            tree[at, size + gone] = never * size
            more = end < n[at]
            before[at[more], end[more]] = i[more]
            new = np.full(len(at), never)
            new[more] = self.rank(ids[at[more], i[more]], ids[at[more], end[more]], never)
            tree[at, size + i] = new * size + i
            left = before[at, i]
            has = left >= 0
            tree[at[has], size + left[has]] = self.rank(ids[at[has], left[has]], ids[at[has], i[has]], never) * size + left[has]
            row = np.concatenate([at, at, at[has]])
            node = (size + np.concatenate([gone, i, left[has]])) >> 1
            while node[0]:
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                node >>= 1
        flat, ends = tuple(ids[live].tolist()), np.cumsum(live.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encodes and decodes whole texts; remembers the ids of short matches within a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split, self.pairs = ranks, regex.compile(pattern), Pairs(ranks)
        self.tokens = by_rank(ranks)
        self.decimals = [str(rank) for rank in range(len(self.tokens))]
        # Tuples, which the garbage collector soon stops to follow.
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Put the ids of matches into ``young``: short ones are merged many at a time."""
        young, old = self.young, self.old
        again = pieces & old.keys()
        young.update((piece, old[piece]) for piece in again)
        new = list(pieces - again)
        raw = [piece.encode() for piece in new]
        known = list(map(self.ranks.get, raw))
        by: dict[int, list[int]] = {}
        for k, rank in enumerate(known):
            if rank is not None:
                young[new[k]] = (rank,)
            elif (n := len(raw[k])) <= TREES:
                by.setdefault(n - 1, []).append(k)
            else:
                young[new[k]] = tuple(merge(raw[k], self.ranks))
        sizes: dict[int, list[int]] = {}
        for n, some in by.items():
            sizes.setdefault(1 << n.bit_length(), []).extend(some)
        for size, some in sizes.items():
            for k in range(0, len(some), ROWS):
                part = some[k : k + ROWS]
                young.update(zip([new[j] for j in part], self.pairs.merge([raw[j] for j in part], size), strict=True))

    def _forget(self, pieces: set[str]) -> None:
        """Keep short matches only, and those of two generations at most."""
        for piece in pieces:
            if len(piece) > CACHED_LENGTH:
                del self.young[piece]
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}

    def encode(self, text: str) -> list[int]:
        """The ids of a text; no special tokens."""
        out: list[int] = []
        for ids in self.encode_all([text]):
            out = ids
        return out

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text. Texts are split in groups of bounded length; a longer one by itself, in runs of matches."""
        group: list[str] = []
        held = 0
        for text in texts:
            if group and held + len(text) > GROUP:
                yield from self._group(group)
                group, held = [], 0
            group.append(text)
            held += len(text)
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[list[int]]:
        if len(texts) == 1 and len(texts[0]) > GROUP:
            out, found = [], (m[0] for m in self.split.finditer(texts[0]))
            while run := list(islice(found, GROUP)):
                out += self._run([run])[0]
            yield out
            return
        yield from self._run([self.split.findall(text) for text in texts])

    def _run(self, found: list[list[str]]) -> list[list[int]]:
        new = set().union(*found).difference(self.young)
        self._learn(new)
        ids = self.young.__getitem__
        out = [list(chain.from_iterable(map(ids, pieces))) for pieces in found]
        self._forget(new)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[str, str]:
        """Of the decimal ids joined by spaces, and of the bytes decoded from them."""
        return sha256(" ".join(map(self.decimals.__getitem__, ids)).encode()).hexdigest(), sha256(self.decode(ids)).hexdigest()


def coded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, row: Callable[[Codec, list[int]], tuple], schema: str) -> DataFrame:
    """``docs`` with the columns of ``schema`` that ``row(codec, ids)`` gives; all others are kept.

    A column of ``docs`` that has a name of ``schema`` is replaced.
    """
    new, kinds = zip(*(field.split() for field in schema.split(", ")), strict=True)
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    kept = [c for c in docs.columns if c not in new]
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file: fixed size
    made = docs.select(*kept).schema
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in made.fields)}, {schema}"
    at = kept.index("text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent, pattern)
        for batch in stream:
            if batch.num_rows:
                rows = [row(codec, ids) for ids in codec.encode_all([text or "" for text in batch.column(at).to_pylist()])]
                columns = [pa.array(list(values), types[kind]) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*kept, *new])

    return docs.select(*kept).mapInArrow(giving_back(run), out)


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(sent, pattern: str) -> Codec:
    """One codec for each vocabulary and worker, so that later tasks find a filled cache."""
    key = (sent._jbroadcast.id() if sent._jbroadcast is not None else id(sent.value), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(sent.value, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids``: the token ids of each text."""
    return coded(docs, load_ranks(path), pattern, lambda codec, ids: (ids,), "ids array<int>")


def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes for the ids in ``column`` (null where those are null)."""
    sent = encoded.sparkSession.sparkContext.broadcast(by_rank(load_ranks(path)))

    @F.udf("binary", useArrow=True)
    def joined(ids):
        return None if ids is None else b"".join(map(sent.value.__getitem__, ids))

    return encoded.withColumn("decoded", joined(F.col(column)))


def coded_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256."""
    return coded(docs, load_ranks(path), pattern, lambda codec, ids: (len(ids), *codec.digests(ids)), "n_tokens long, ids_sha256 string, decoded_sha256 string")


def coded_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with n_tokens, ids, ids_sha256 and decoded_sha256."""

    def row(codec: Codec, ids: list[int]) -> tuple:
        return len(ids), ids, *codec.digests(ids)

    return coded(docs, load_ranks(path), pattern, row, "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return coded_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


QUERIES = {"op2_byte_bpe": query}
ORACLE_SQL: dict[str, str] = {}
