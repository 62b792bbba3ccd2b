import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from annalist.llm import run_index as ri

from .fixtures import documents, nothing, prose, rows, texts


def expected(rows, window=400):
    """By counting every window."""
    every = [(k, (t or "").encode()) for k, t in rows]
    count = Counter(t[i : i + window] for _, t in every for i in range(len(t) - window + 1))
    out = []
    for k, t in every:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((k, len(t), int(gone.sum()), spans, sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def test_long_matches_equal_brute_force():
    draw = random.Random(2)
    for _ in range(200):
        base = [bytes(draw.choices(b"ab\0\xff", k=draw.randint(1, 40))) for _ in range(4)]
        own = [b"".join(draw.choice(base) if draw.random() < 0.8 else bytes(draw.choices(b"abc", k=draw.randint(0, 5))) for _ in range(draw.randint(0, 10))) for _ in range(draw.randint(1, 6))]
        least = draw.randint(1, 30)
        count = Counter(t[i : i + least] for t in own for i in range(len(t) - least + 1))
        got = [[i for a, b in ranges for i in range(a, b)] for ranges in ri.long_matches(own, least)]
        assert got == [[i for i in range(len(t) - least + 1) if count[t[i : i + least]] > 1] for t in own]


def test_each_window_lies_in_one_block_whose_anchor_follows_from_its_bytes(monkeypatch):
    draw = random.Random(3)
    piece = bytes(draw.choices(b"abcdefgh", k=900))
    own = [piece, b"", b"x" * 700, bytes(draw.choices(b"abc", k=300)) + piece, b"short"]
    data, bounds = np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in own])])
    for size in (1 << 20, 64):
        monkeypatch.setattr(ri, "PIECE", size)
        anchors, seen = {}, set()
        for text, anchor, _, first, windows, offset in zip(*(x.tolist() for x in ri.blocks(data, bounds)), strict=True):
            for i in range(first, first + windows):
                assert anchors.setdefault(own[text][i : i + 400], (anchor, first + offset - i)) == (anchor, first + offset - i)
                assert (text, i) not in seen
                seen.add((text, i))
        assert len(seen) == sum(max(0, len(t) - 399) for t in own)


def corpus():
    """Exact and near copies, a passage in many texts, periodic texts, and matches of just under and over a window."""
    draw = random.Random(5)
    passage, line = prose(700, 90), prose(701, 40)
    out = [(k, prose(800 + k, 100)) for k in range(6)]
    for k in range(30):
        own = prose(900 + k, 60).split()
        out.append((100 + k, " ".join([*own[:30], passage, *own[30:]])))
        out.append((200 + k, " ".join([*own[30:], line, *own[:30]])))
    body = prose(999, 300)
    for k in range(25):
        at = draw.randrange(len(body))
        out.append((300 + k, body[:at] + f"#{k}#" + body[at:]))
    out += [(400, body[:399]), (401, body[:400]), (402, body[:401]), (403, "é" * 500), (404, "ab" * 1000), (405, "é" * 300 + prose(1, 5))]
    return out


@pytest.mark.parametrize("hot", [1024, 3])
def test_report_equals_counting(spark, monkeypatch, hot):
    monkeypatch.setattr(ri, "HOT", hot)
    monkeypatch.setattr(ri, "BUCKET", 20_000)
    every = corpus() + [(k, t) for k, t in texts() if len(t or "") < 40_000]
    docs = spark.createDataFrame(every, "doc_id long, text string").repartition(3)
    from annalist.llm.common import cut

    got = sorted((tuple(r) for r in ri.report(cut(docs)).collect()), key=repr)
    assert got == expected(every)


def test_hard_cases_and_columns(spark):
    docs = documents(spark)
    got = ri.without_repeats(docs)
    assert got.columns == docs.columns
    assert got.count() == len(rows())
    kept = {r["doc_id"]: r["text"] for r in got.collect() if r["doc_id"] in (100, 101, 107, 0)}
    assert kept == {100: None, 101: "", 107: "#$% 12 345 !!", 0: prose(0, 80)}
    assert ri.report(nothing(spark)).count() == 0 == ri.without_repeats(nothing(spark)).count()
    assert {r["n_removed"] for r in ri.report(docs).collect() if r["doc_id"] == 104} == {50_000}
