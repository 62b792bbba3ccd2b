"""Language-model scores by a back-off automaton of three words, whole at any size of the corpus.

States are the contexts of two words, of one word and of none. Each n-gram of the training texts is
an arc from its context to the longest context that it ends in; a word without an arc takes the
failure arc to the shorter context, whose weight multiplies what follows. Probabilities are smoothed
by absolute discounting: an arc of an n-gram that occurs n times has (n - D) / c and the weight times
the shorter context's probability; the weight is D * T / c, where c counts the context and T its
different followers. D is n1 / (n1 + 2 n2) of each order. Nothing is pruned: every n-gram counts,
those that occur once too.

The automaton grows with the corpus, so no process holds it. Texts are taken in chunks of about
``CHUNK`` tokens. A chunk sends its distinct contexts and n-grams with their counts, dealt by the
hash of the context, to buckets; a bucket adds up what all chunks sent and answers each chunk with
the corpus' numbers, in the chunk's own order, so that no names travel back. Where the answers of a
chunk meet its texts they are the part of the automaton that the texts can reach: its states are
numbered, its arcs sorted, and one traversal from left to right carries the state, follows arcs and
failure arcs and adds up their logarithms. Many lanes walk at once, each a stretch of ``LANE``
tokens; two tokens before its stretch a lane starts in the state of no words, which they take to the
state that the whole text before would have led to, as no state is longer.

Words and contexts go by hashes whose width follows from the number of tokens that the sample
estimates: a context meets another by chance in about one of 2 ** 22 cases (more if the estimate is
low, and at 64 bits at most). Followers go by 32 bits within their context, so that of n followers of
one context some n * n / 2 ** 33 pairs merge: none of ten thousand, 100 of a million. Contexts of
words that the sample shows to be frequent are dealt, by follower, over several buckets whose sums
are added.

Defined cases: a null or empty text consists of its end; with no training text every token is
unknown and scores 0 in the model; all unknown words share the mass of the discounts; a text of any
length is read whole; repeated rows are each scored; a null doc_id counts as remainder 0; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import cut, flat_bytes, giving_back, remainder, table, utf8

#: Tokens of a chunk and, as estimated, of a bucket.
CHUNK, BUCKET = 1 << 21, 1 << 20
#: Buckets at least and at most.
BUCKETS = (64, 1 << 20)
#: The share of rows in the sample that shows sizes and frequent words, and the least share of a frequent word.
SAMPLE, FREQUENT = 0.01, 1 / 1024
#: Spare bits of a hash beyond those that count the corpus' tokens.
SPARE_BITS = 22
#: Bytes of text that are hashed at once.
PIECE = 1 << 18
#: Tokens of a lane of the traversal.
LANE = 256


# ---- words and hashes

_MULTIPLIER = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers scattered over 64 bits; different ones stay different."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte, the same for both cases of A-Z, and whether a byte belongs to a word."""
    number = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
    number[ord("A") : ord("Z") + 1] = number[ord("a") : ord("z") + 1]
    inside = np.ones(256, bool)
    inside[[32, *range(9, 14)]] = False
    return number, inside


_NUMBER, _INSIDE = _tables()


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd number and of its inverse, modulo 2 ** 64."""
    both = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        both.append(np.cumprod(factors))
    return both[0], both[1]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, number of words of each text); text k is data[bounds[k]:bounds[k + 1]]."""
    inside = _INSIDE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    begins[edges], ends[edges - 1] = inside[edges], inside[edges - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        low = begin[at]
        upto = max(at + 1, int(np.searchsorted(end, low + PIECE, "right")))
        size = int(end[upto - 1] - low)
        up, down = _powers(max(size, PIECE) + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_NUMBER[data[low : low + size]] * up[:size], out=sums[1:])
        out[at:upto] = (sums[end[at:upto] - low] - sums[begin[at:upto] - low]) * down[begin[at:upto] - low]
        at = upto
    return mixed(out + (end - begin).astype(np.uint64)), np.diff(np.searchsorted(begin, bounds))


START, END = (int(x) for x in mixed(np.array([1, 2], np.uint64)))


# ---- packing


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers as bytes: places of equal weight together, compressed."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        parts += [struct.pack("<QB", len(a), width), np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    """What ``pack`` was given, as 64-bit numbers."""
    data, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(data):
        n, width = struct.unpack_from("<QB", data, at)
        at += 9
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        out.append(a.view("<u8").ravel())
        at += n * width
    return out


def gaps(ordered: np.ndarray) -> np.ndarray:
    """Steps between ordered numbers, from 0."""
    return np.diff(ordered, prepend=np.uint64(0))


# ---- where n-grams go


class Deal:
    """Width of hashes, number of buckets, and over how many buckets the followers of frequent words are dealt."""

    def __init__(self, tokens: int, frequent: dict[int, float]):
        self.chunk = CHUNK
        self.bits = min(64, max(CHUNK, tokens).bit_length() + SPARE_BITS)
        wanted = max(1, tokens // BUCKET)
        self.bucket_bits = min(max(wanted, BUCKETS[0]), BUCKETS[1]).bit_length() - 1
        pieces = {h: 1 << max(0, int(4 * share * self.buckets).bit_length()) for h, share in frequent.items()}
        self.names = np.array(sorted(h for h, n in pieces.items() if n > 1), np.uint64)
        self.counts = np.array([pieces[int(h)] for h in self.names], np.uint64)

    @property
    def buckets(self) -> int:
        return 1 << self.bucket_bits

    def narrow(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def bucket(self, contexts: np.ndarray) -> np.ndarray:
        return contexts >> np.uint64(self.bits - self.bucket_bits)

    def pieces(self, words: np.ndarray) -> np.ndarray:
        """Over how many buckets the followers of each (narrow) word hash go."""
        out = np.ones(len(words), np.uint64)
        if len(self.names):
            names = self.narrow(self.names)
            at = np.minimum(np.searchsorted(names, words), len(names) - 1)
            out = np.where(names[at] == words, self.counts[at], out)
        return out


class Asked:
    """Entries (context, follower, count) in the order in which a chunk sends them.

    ``base`` names each entry's context within the chunk; ``pieces`` over how many buckets the context goes.
    """

    def __init__(self, deal: Deal, context: np.ndarray, base: np.ndarray, follower: np.ndarray, n: np.ndarray, pieces: np.ndarray):
        self.entries = len(base)
        own = context[base]
        split = np.flatnonzero(pieces[base] > 1)
        if len(split):
            turn = (follower[split] >> np.uint64(32)) & (pieces[base[split]] - np.uint64(1))
            own[split] = self._piece(deal, own[split], turn)
            # Each piece is asked for its followers' number, also where the chunk has none of them.
            many = np.unique(base[split])
            times = pieces[many].astype(np.int64)
            more = np.repeat(many, times)
            turn = np.arange(len(more)) - np.repeat(np.cumsum(times) - times, times)
            own = np.concatenate([own, self._piece(deal, context[more], turn.astype(np.uint64))])
            base = np.concatenate([base, more])
            follower = np.concatenate([follower, np.zeros(len(more), np.uint64)])
            n = np.concatenate([n, np.zeros(len(more), n.dtype)])
        self.order = np.argsort(own, kind="stable")
        own = own[self.order]
        new = np.flatnonzero(np.diff(own, prepend=~own[:1]) != 0) if len(own) else np.zeros(0, np.int64)
        self.contexts, self.sizes = own[new], np.diff(new, append=len(own))
        self.base = base[self.order][new]
        self.followers = follower[self.order] & np.uint64(0xFFFFFFFF)
        self.n = n[self.order]

    @staticmethod
    def _piece(deal: Deal, context: np.ndarray, turn: np.ndarray) -> np.ndarray:
        return deal.narrow(mixed(context * np.uint64(_MULTIPLIER) + turn + np.uint64(1)))

    def messages(self, deal: Deal) -> Iterator[tuple[int, bytes]]:
        """(bucket, what it is sent)."""
        bucket = deal.bucket(self.contexts)
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        every, first = np.unique(bucket, return_index=True)
        for k, i, j in zip(every.tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
            a, b = ends[i], ends[j]
            yield int(k), pack(gaps(self.contexts[i:j]), self.sizes[i:j], self.followers[a:b], self.n[a:b])


class Chunk:
    """Some texts as numbered tokens, and their distinct n-grams.

    ``words`` are the sorted narrow hashes, ``ids`` the tokens of all texts, each text between a
    start and an end; ``sizes`` their numbers; ``train`` the texts that are learned from.
    """

    def __init__(self, deal: Deal, words: np.ndarray, ids: np.ndarray, sizes: np.ndarray, train: np.ndarray):
        self.deal, self.words, self.ids, self.train, v = deal, words, ids, train, max(len(words), 1)
        first = np.zeros(len(ids), bool)
        first[np.cumsum(sizes) - sizes] = True
        self.starts, at = ids[first], np.flatnonzero(~first).astype(np.int32)
        self.text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes - 1)
        self.word = ids[at].astype(np.int32)
        self.pairs, self.pair = _numbered(ids[at - 1].astype(np.int64) * v + self.word)
        self.third = np.flatnonzero(~first[at - 1]).astype(np.int32)
        del first, at
        self.triples, self.triple = _numbered(self.pair[self.third - 1].astype(np.int64) * v + self.word[self.third])
        #: Context and last word of each pair; context and last pair of each triple.
        self.one, self.two = (x.astype(np.int32) for x in np.divmod(self.pairs, v))
        self.before = (self.triples // v).astype(np.int32)
        self.shorter = np.zeros(len(self.triples), np.int32)
        self.shorter[self.triple] = self.pair[self.third]

    def asked(self, kind: int) -> Asked:
        """What the chunk asks of its words, pairs or triples."""
        deal, words, v = self.deal, self.words, max(len(self.words), 1)
        learned = np.repeat(self.train, np.bincount(self.text, minlength=len(self.train)))
        if kind == 0:
            n = np.bincount(self.word, learned, len(words)) + np.bincount(self.starts, self.train, len(words))
            return Asked(deal, words, np.arange(len(words)), np.zeros(len(words), np.uint64), n, np.ones(len(words), np.uint64))
        names, pieces = mixed(words), deal.pieces(words)
        if kind == 1:
            return Asked(deal, words, self.one, names[self.two], np.bincount(self.pair, learned, len(self.pairs)), pieces)
        contexts = deal.narrow(mixed(words[self.one] * np.uint64(_MULTIPLIER) + names[self.two]))
        n = np.bincount(self.triple, learned[self.third], len(self.triples))
        return Asked(deal, contexts, self.before, names[self.triples % v], n, np.minimum(pieces[self.one], pieces[self.two]))

    def answers(self, kind: int, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(count of each entry, followers of each context), from the buckets' answers in their order, which are used up."""
        found = [[np.zeros(0, np.uint64)] * 2, *(unpack(part) for part in parts)]
        parts.clear()
        counts, types = (np.concatenate([f[k] for f in found]).astype(np.float64) for k in (0, 1))
        del found
        asked = self.asked(kind)
        if len(counts) != len(asked.n) or len(types) != len(asked.contexts):
            raise ValueError("the texts of a chunk changed between two reads")
        out = np.zeros(len(asked.order))
        out[asked.order] = counts
        groups = (len(self.words), len(self.words), len(self.pairs))[kind]
        return out[: asked.entries], np.bincount(asked.base, types, groups)

    def automaton(self, totals: Totals, parts: list[list[bytes]]) -> tuple[Automaton, np.ndarray]:
        """The part of the automaton that these texts can reach, and how often each word occurs in the corpus."""
        n1, _ = self.answers(0, parts[0])
        n2, followers1 = self.answers(1, parts[1])
        n3, followers2 = self.answers(2, parts[2])
        v = max(len(self.words), 1)
        one, two, three = (np.flatnonzero(n > 0) for n in (n1, n2, n3))
        # States: none, the known words, the known pairs; 0 also stands for what is not known.
        of_word, of_pair = np.zeros(len(n1), np.int32), np.zeros(len(n2), np.int32)
        of_word[one] = np.arange(1, len(one) + 1)
        of_pair[two] = np.arange(len(one) + 1, len(one) + len(two) + 1)
        fall1, fall2 = (totals.fall(k, types[own], n[own]) for k, types, n, own in ((1, followers1, n1, one), (2, followers2, n2, two)))
        weight1, weight2 = np.zeros(len(n1)), np.zeros(len(n2))
        weight1[one], weight2[two] = fall1, fall2
        # What a known n-gram ends in is known too. Arcs lie in order of state, so each order fills its slice.
        first, second = len(one), len(one) + len(two)
        keys, logs = np.empty(second + len(three), np.int64), np.empty(second + len(three))
        targets = np.empty(second + len(three), np.int32)
        p1, p2 = totals.unigram(n1), np.zeros(len(n2))
        keys[:first], targets[:first], logs[:first] = one, of_word[one], p1[one]
        before, last = self.one[two], self.two[two]
        p2[two] = totals.taken(1, n2[two], n1[before]) + weight1[before] * p1[last]
        keys[first:second] = of_word[before].astype(np.int64) * v + last
        targets[first:second], logs[first:second] = of_pair[two], p2[two]
        failing = of_word[last]
        before, shorter = self.before[three], self.shorter[three]
        logs[second:] = totals.taken(2, n3[three], n2[before]) + weight2[before] * p2[shorter]
        keys[second:] = of_pair[before].astype(np.int64) * v + self.triples[three] % v
        targets[second:] = of_pair[shorter]
        np.log10(logs, out=logs)
        failures = np.concatenate([np.zeros(first + 1, np.int32), failing])
        # A context that nothing follows in these texts is never left by its failure arc.
        falls = np.concatenate([[0.0], fall1, fall2])
        falls = np.log10(np.where(falls > 0, falls, 1.0))
        unknown = float(np.log10(totals.unigram(np.zeros(1))[0]))
        return Automaton(v, keys, targets, logs, failures, falls, unknown), n1

    def scores(self, totals: Totals, parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, score) of each text."""
        automaton, n1 = self.automaton(totals, parts)
        # The walk needs the tokens only.
        del self.pairs, self.pair, self.triples, self.triple, self.third, self.one, self.two, self.before, self.shorter
        base, texts = np.log10((n1 + 1) / (totals.tokens + totals.types + 1)), len(self.train)
        known, plain = (np.bincount(self.text, w[self.word], texts) for w in (n1 > 0, base))
        start = int(self.starts[0])
        return known, plain, np.bincount(self.text, automaton.walked(self.ids, start)[self.ids != start], texts)


class Automaton:
    """States with arcs and failure arcs; state 0 is that of no words.

    ``keys`` are the arcs' states * ``size`` + words in order, with ``targets`` and ``logs``;
    ``failures`` and ``falls`` each state's failure arc and its weight's logarithm. In state 0 a word
    without an arc has ``unknown`` and leads back.
    """

    def __init__(self, size: int, keys: np.ndarray, targets: np.ndarray, logs: np.ndarray, failures: np.ndarray, falls: np.ndarray, unknown: float):
        self.size, self.keys, self.targets, self.logs = size, keys, targets, logs
        self.failures, self.falls, self.unknown = failures, falls, unknown

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log-probabilities) of words read in states."""
        out, logs = np.zeros(len(states), np.int32), np.zeros(len(states))
        left, now = np.arange(len(states)), states
        while len(left):
            wanted = now.astype(np.int64) * self.size + words[left]
            at = np.searchsorted(self.keys, wanted)
            found = at < len(self.keys)
            found[found] = self.keys[at[found]] == wanted[found]
            out[left[found]] = self.targets[at[found]]
            logs[left[found]] += self.logs[at[found]]
            lost = ~found & (now == 0)
            logs[left[lost]] += self.unknown
            fails = ~found & (now > 0)
            left, now = left[fails], now[fails]
            logs[left] += self.falls[now]
            now = self.failures[now]
        return out, logs

    def walked(self, words: np.ndarray, start: int) -> np.ndarray:
        """The log-probability of each word where all are read from left to right; ``start`` begins a text and has none."""
        n = len(words)
        lanes = -(-n // LANE)
        padded = np.full(lanes * LANE + 2, start, np.int32)
        padded[2 : n + 2] = words
        out = np.zeros((LANE, lanes))
        states = np.zeros(lanes, np.int32)
        for t in range(-2, LANE):
            now = padded[t + 2 :: LANE][:lanes]
            begins = now == start
            states, logs = self.step(np.where(begins, 0, states), now)
            if t >= 0:
                out[t] = np.where(begins, 0.0, logs)
        return out.T.ravel()[:n]


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them."""
    found, inverse = np.unique(keys, return_inverse=True)
    return found, inverse.astype(np.int32)


class Totals:
    """What the whole corpus has: tokens, different tokens and the discount of each order."""

    def __init__(self, tokens: int, types: int, times: list[tuple[int, int]]):
        self.tokens, self.types = tokens, types
        self.discounts = [once / (once + 2 * twice) if once and twice else 0.5 for once, twice in times]

    def unigram(self, n: np.ndarray) -> np.ndarray:
        size, d = max(self.tokens, 1), self.discounts[0]
        return np.where(n > 0, (n - d) / size, d * self.types / size if self.tokens else 1.0)

    def taken(self, words: int, n: np.ndarray, context: np.ndarray) -> np.ndarray:
        """What an arc keeps of n occurrences after a context of so many words."""
        return np.maximum(n - self.discounts[words], 0) / context

    def fall(self, words: int, followers: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The weight of the failure arc of a context of so many words."""
        return self.discounts[words] * followers / context


# ---- the passes


def chunks(deal: Deal, stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
    """(name, words, tokens and texts' sizes of a chunk, its rows without texts) of rows (row, doc_id, held_out, text).

    Chunks end after the row that fills them, whatever the batches, so that two reads make the same ones.
    """
    start, end = (int(deal.narrow(np.array([x], np.uint64))[0]) for x in (START, END))
    held: list[tuple[np.ndarray, np.ndarray, pa.RecordBatch]] = []
    size = 0

    def made() -> tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
        rows = pa.Table.from_batches([b for _, _, b in held]).combine_chunks()
        counts = np.concatenate([c for _, c, _ in held])
        sizes = counts + 2
        tokens = np.full(int(sizes.sum()), end, np.uint64)
        stops = np.cumsum(sizes)
        tokens[stops - sizes] = start
        inner = np.ones(len(tokens), bool)
        inner[stops - sizes] = inner[stops - 1] = False
        tokens[inner] = np.concatenate([h for h, _, _ in held])
        held.clear()
        words, ids = _numbered(tokens)
        return rows["row"][0].as_py(), words, ids, sizes, rows

    for batch in stream:
        if not batch.num_rows:
            continue
        data, bounds = flat_bytes(batch.column(3))
        hashes, counts = word_hashes(data, bounds)
        hashes, rest = deal.narrow(hashes), batch.select([0, 1, 2])
        upto = np.cumsum(counts + 1)
        begin = 0
        while begin < len(counts):
            before = upto[begin] - counts[begin] - 1
            stop = int(np.searchsorted(upto, before + deal.chunk - size)) + 1
            full, stop = stop <= len(counts), min(stop, len(counts))
            a, b = (int(counts[:k].sum()) for k in (begin, stop))
            held.append((hashes[a:b], counts[begin:stop], rest.slice(begin, stop - begin)))
            size += int(upto[stop - 1] - before)
            if full:
                size = 0
                yield made()
            begin = stop
    if held:
        yield made()


def sampled(docs: DataFrame) -> Deal:
    """Sizes and frequent words, as a sample of the rows of ``docs`` (row, doc_id, held_out, text) shows them."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [word_hashes(*flat_bytes(batch.column(3)))[0] for batch in stream if batch.num_rows]
        words, n = np.unique(np.concatenate(every) if every else np.zeros(0, np.uint64), return_counts=True)
        # A word that is frequent in all is so in some task; a task passes on 1 / FREQUENT words at most.
        often = n >= max(2, FREQUENT * n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([None, *words[often].view(np.int64).tolist()], pa.int64()), pa.array([int(n.sum()), *n[often].tolist()], pa.int64())], ["word", "n"])

    found = docs.sample(SAMPLE, seed=1).mapInArrow(giving_back(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    tokens = found.filter("word is null").first()
    tokens = tokens["n"] if tokens else 0
    often = found.filter(F.col("word").isNotNull() & (F.col("n") >= F.lit(FREQUENT * tokens))).collect() if tokens else []
    return Deal(int(tokens / SAMPLE), {int(np.uint64(r["word"] % (1 << 64))): r["n"] / tokens for r in often})


def bucket_sums(messages: list[list[np.ndarray]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(answer to each message, its contexts' numbers, its entries' numbers) of one bucket and kind."""
    contexts = [np.cumsum(m[0]) for m in messages]
    every, number = np.unique(np.concatenate(contexts), return_inverse=True)
    owner = np.repeat(number, np.concatenate([m[1] for m in messages]).astype(np.int64)).astype(np.uint64)
    entries, at = np.unique(owner << np.uint64(32) | np.concatenate([m[2] for m in messages]), return_inverse=True)
    n = np.bincount(at, np.concatenate([m[3] for m in messages]).astype(np.float64), len(entries)).astype(np.int64)
    types = np.bincount((entries >> np.uint64(32)).astype(np.int64), n > 0, len(every)).astype(np.int64)
    out, a, i = [], 0, 0
    for m in messages:
        b, j = a + len(m[2]), i + len(m[0])
        out.append(pack(n[at[a:b]], types[number[i:j]]))
        a, i = b, j
    return out, every, n


_ANSWERS = "chunk long, kind int, bucket int, payload binary, once long, twice long, tokens long, types long"


def answered(docs: DataFrame, deal: Deal) -> DataFrame:
    """What each bucket answers each chunk, and with a null ``chunk`` what it knows of the corpus."""

    def ask(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, words, ids, sizes, own in chunks(deal, stream):
            chunk = Chunk(deal, words, ids, sizes, ~own["held_out"].to_numpy())
            for kind in range(3):
                for bucket, payload in chunk.asked(kind).messages(deal):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([name], pa.int64()), pa.array([payload], pa.binary())], ["bucket", "kind", "chunk", "payload"])

    start = int(deal.narrow(np.array([START], np.uint64))[0])

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, messages = None, [], []

        def out() -> pa.RecordBatch:
            replies, contexts, n = bucket_sums(messages)
            bucket, kind = now
            words = n[contexts != np.uint64(start)] if kind == 0 else n
            numbers = [int((words == 1).sum()), int((words == 2).sum()), int(words.sum()), int((words > 0).sum())]
            k = len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array([*names, None], pa.int64()), pa.array([kind] * (k + 1), pa.int32()), pa.array([bucket] * (k + 1), pa.int32()), pa.array([*replies, None], pa.binary()), *(pa.array([None] * k + [x], pa.int64()) for x in numbers)],
                [field.split()[0] for field in _ANSWERS.split(", ")],
            )

        for batch in stream:
            for bucket, kind, name, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and now != (bucket, kind):
                    yield out()
                    names, messages = [], []
                now = (bucket, kind)
                names.append(name)
                messages.append(unpack(payload))
        if now is not None:
            yield out()

    sent = docs.mapInArrow(giving_back(ask), "bucket int, kind int, chunk long, payload binary").repartition(deal.buckets, "bucket")
    return sent.sortWithinPartitions("bucket", "kind", "chunk").mapInArrow(giving_back(add), _ANSWERS)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, held_out, text as bytes).

    Rows that are not ``held_out`` are learned from. ``docs`` is read twice and its rows are known by
    their places, so it must be a scan or a written table, not a shuffle.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *docs.columns).toDF("row", "doc_id", "held_out", "text")
    deal = sampled(rows)
    found = cut(answered(rows, deal))
    known = {r["kind"]: r for r in found.filter("chunk is null").groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("once", "twice", "tokens", "types"))).collect()}
    times = [(known[k]["once"], known[k]["twice"]) if k in known else (0, 0) for k in range(3)]
    totals = Totals(known[0]["tokens"], known[0]["types"], times) if 0 in known else Totals(0, 0, times)

    def kept(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, words, ids, sizes, own in chunks(deal, stream):
            doc_ids, held_out = own["doc_id"], own["held_out"].to_numpy().astype(np.uint64)
            nulls = doc_ids.is_null().to_numpy().astype(np.uint64)
            numbers = doc_ids.fill_null(0).to_numpy().view(np.uint64)
            payload = pack(gaps(words), ids, sizes, numbers, nulls, held_out)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([payload], pa.binary())], ["chunk", "kind", "bucket", "payload"])

    def traverse(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, [[], [], [], []]

        def out() -> pa.RecordBatch:
            steps, ids, sizes, numbers, nulls, held_out = unpack(parts[-1][0])
            sizes, held = sizes.astype(np.int64), held_out.astype(bool)
            chunk = Chunk(deal, np.cumsum(steps), ids.astype(np.int32), sizes, ~held)
            del steps, ids, held_out
            parts[-1].clear()
            known, base, score = chunk.scores(totals, parts[:3])
            k = len(sizes)
            columns = [pa.array(numbers.view(np.int64), mask=nulls.astype(bool)), pa.array(held), pa.array(sizes - 1), pa.array(known.astype(np.int64)), pa.array(np.full(k, totals.tokens)), pa.array(base), pa.array(score)]
            return pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in _SCORES.split(", ")])

        for batch in stream:
            for name, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:
                    if now is not None:
                        yield out()
                    now, parts = name, [[], [], [], []]
                parts[kind].append(payload)
        if now is not None:
            yield out()

    texts = rows.mapInArrow(giving_back(kept), "chunk long, kind int, bucket int, payload binary")
    both = found.filter("chunk is not null").select("chunk", "kind", "bucket", "payload").unionByName(texts)
    met = both.repartition(deal.buckets, "chunk").sortWithinPartitions("chunk", "kind", "bucket").select("chunk", "kind", "payload")
    # Written at once: the two reads of the rows must be dealt alike.
    return cut(met.mapInArrow(giving_back(traverse), _SCORES))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all documents, learned from those whose remainder by 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 7) == 2
    return scored(docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), utf8(F.col("text"))))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {"op5_lm_score": query}
ORACLE_SQL: dict[str, str] = {}
