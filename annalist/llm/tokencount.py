"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton names every vocabulary entry that ends at a position; for each position
only the best score and the piece count of its path are carried, in a ring as long as the longest
entry. Texts are segmented as a unigram tokenizer with word marks and byte fallback does: spaces
become U+2581, one is put before the text unless it has one, each mark begins a new piece of text,
and the search runs on each piece alone. Of equal scores the path found first wins, starts taken
from the left: for a fixed end, the longest entry. A character without an entry of its own length
may be taken as unknown, at the least score minus 10, and counts as the byte entries of its UTF-8
form if all of them exist; else each run of unknown characters counts once.

Defined cases: a null or empty text has no tokens and score 0; a text of any length is read whole;
repeated rows are each returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from annalist.llm.common import table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Pieces of text kept in each of a worker's two generations, and the longest that is kept.
CACHED, CACHED_LENGTH = 1 << 18, 48


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Entries and scores, in order of id, of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the tokens of whole texts."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {piece for piece, _ in pieces}
        self.fallback = {f"<0x{b:02X}>" in names for b in range(256)} == {True}
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(piece) for piece, _ in pieces), default=1)
        self.young: dict[str, tuple[int, float]] = {}
        self.old: dict[str, tuple[int, float]] = {}

    def viterbi(self, piece: str) -> tuple[int, float]:
        """(tokens, score) of the best segmentation of one piece of text."""
        size = self.longest + 1
        best, count, run = [0.0] * size, [0] * size, [False] * size  # run: the path ends in unknown characters
        step = self.automaton.iter(piece)
        end, found = next(step, (len(piece), None))
        for i, char in enumerate(piece):
            top, tokens, unknown, single = None, 0, False, False
            while end == i and found is not None:
                length, score = found
                at = (i + 1 - length) % size
                if (tried := best[at] + score) > (top if top is not None else float("-inf")):
                    top, tokens, unknown = tried, count[at] + 1, False
                single = single or length == 1
                end, found = next(step, (len(piece), None))
            if not single:
                at = i % size
                if top is None or best[at] + self.unknown > top:
                    top, unknown = best[at] + self.unknown, True
                    tokens = count[at] + (len(char.encode("utf-8", "replace")) if self.fallback else 0 if run[at] else 1)
            at = (i + 1) % size
            best[at], count[at], run[at] = top, tokens, unknown
        at = len(piece) % size
        return count[at], best[at]

    def _one(self, piece: str) -> tuple[int, float]:
        found = self.old.get(piece) or self.viterbi(piece)
        if len(piece) <= CACHED_LENGTH:
            if len(self.young) >= CACHED:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def count(self, text: str | None) -> tuple[int, float]:
        """(tokens, score) of a text."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", MARK)
        first, *rest = marked.split(MARK)
        tokens, total = self._one(MARK + first) if first else (0, 0.0)
        get = self.young.get
        for word in rest:
            n, score = get(MARK + word) or self._one(MARK + word)
            tokens += n
            total += score
        return tokens, total


#: The counter of the vocabulary that a worker used last, by the name of its broadcast.
_COUNTERS: dict[str, Counter] = {}


def counted(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """``docs`` with n_tokens and score; columns of these names are replaced."""
    docs = docs.drop("n_tokens", "score")
    at, sent = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary file: fixed size
    name = uuid.uuid4().hex

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[name] = Counter(sent.value)
        counter = _COUNTERS[name]
        for batch in stream:
            if batch.num_rows:
                found = [counter.count(text) for text in batch.column(at).to_pylist()]
                columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "n_tokens", "score"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{out}, n_tokens long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and path scores of all documents."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(docs, load_pieces(public_tokenizers.path("piece_bpe_32k.model"))).drop("text")


QUERIES = {"op4_token_count": query}
ORACLE_SQL: dict[str, str] = {}
