import re
from collections import defaultdict

from annalist.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, extra string, part long"


def rows():
    out = [(0, 0, "system", "s"), (0, 1, "user", "u"), (0, 2, "assistant", "good"), (0, 3, "user", "x"), (0, 4, "assistant", "end")]
    out += [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "bad é\U0001f600")]
    out += [(2, 0, "user", "alone"), (2, 1, "assistant", "a")]
    out += [(4, 0, "user", "same"), (5, 0, "user", "same"), (5, 0, "user", "same")]
    out += [(6, None, None, None), (6, 1, "assistant", "<|im_end|> t"), (7, None, None, None), (7, 1, "user", "b"), (7, 1, "assistant", "c")]
    out += [(8 + s, t, ("user", "assistant")[t % 2], f"t{t}" if t < 300 else f"t{t} {s}") for s in (0, 1) for t in range(600)]
    out += [(None, 0, "user", "nobody"), (11, 0, "user", "odd only")]
    return [(*r, "e", 7) for r in out]


def brute(data, size):
    sides = defaultdict(set)
    for conv, turn, role, text, *_ in data:
        if conv is not None:
            sides[conv].add((-1 if turn is None else turn, role or "user", (text or "").replace("<|", "< |")))
    out = {}
    for pair in {c >> 1 for c in sides}:
        c, r = sides[2 * pair], sides[2 * pair + 1]
        split = min((t for t, *_ in c ^ r), default=float("inf"))
        for part in {t // size for t, *_ in c | r}:
            own = lambda rows, keep: sorted(x for x in rows if x[0] // size == part and keep(x[0]))  # noqa: E731, B023
            texts, spans = [], []
            for turns in (own(c | r, lambda t: t < split), own(c, lambda t: t >= split), own(r, lambda t: t >= split)):
                text, span = "", []
                for _, role, said in turns:
                    start = len(text) + len(f"<|im_start|>{role}\n")
                    text += f"<|im_start|>{role}\n{said}<|im_end|>\n"
                    span += [(start, len(text))] if role == "assistant" else []
                texts.append(text)
                spans.append(span)
            out[pair, part] = (bool(c) and bool(r), *texts, *spans[1:])
    return out


def found(frame):
    return {(r.pair_id, r.part if "part" in frame.columns else 0): (r.paired, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_spans], [tuple(s) for s in r.rejected_spans]) for r in frame.collect()}


def test_pairs(spark):
    """One row for each pair, also for one of 600 turns; a null turn comes first."""
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    out = found(chat.formatted(chat.neighbours(frame)))
    expected = brute(rows(), 10**9)
    joined = {}
    for (pair, part), own in sorted(expected.items()):  # a null turn is number -1, before part 0
        joined[pair, 0] = own if (pair, 0) not in joined else _after(joined[pair, 0], own)
    assert out == joined
    assert out[4, 0][1].count("<|im_start|>") == 300 and out[4, 0][2].count("<|im_start|>") == 300 == out[4, 0][3].count("<|im_start|>")


def _after(a, b):
    move = lambda spans, text: [(x + len(text), y + len(text)) for x, y in spans]
    return (a[0], a[1] + b[1], a[2] + b[2], a[3] + b[3], a[4] + move(b[4], a[2]), a[5] + move(b[5], a[3]))


def test_parts_are_the_whole_in_pieces(spark):
    sides = chat.neighbours(spark.createDataFrame(rows(), SCHEMA).repartition(3))
    out = found(chat.parts(sides))
    assert out == brute(rows(), chat.PART) and len([k for k in out if k[0] == 4]) == 3
    joined = {}
    for (pair, _), own in sorted(out.items()):
        joined[pair, 0] = own if (pair, 0) not in joined else _after(joined[pair, 0], own)
    assert joined == found(chat.formatted(sides))


def test_prompt_is_the_longest_common_prefix(spark):
    out = found(chat.formatted(chat.neighbours(spark.createDataFrame(rows(), SCHEMA))))
    assert out[0, 0][1] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n"
    said = [out[0, 0][2][a:b] for a, b in out[0, 0][4]]
    assert said == ["good<|im_end|>\n", "end<|im_end|>\n"]
    assert out[1, 0][0] is False and out[1, 0][1] == ""
    assert out[2, 0][2:4] == ("", "")


def test_explicit_pairs(spark):
    turns = spark.createDataFrame(rows(), SCHEMA)
    pairs = spark.createDataFrame([("p", 0, 1), ("q", 4, 0)], "pair_id string, chosen_id long, rejected_id long")
    out = found(chat.formatted(chat.sided(turns, pairs)))
    assert out["p", 0] == brute(rows(), 10**9)[0, 0]
    assert out["q", 0][1] == ""


def test_no_python_in_the_plan(spark):
    plan = chat.formatted(chat.neighbours(spark.createDataFrame(rows(), SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert chat.formatted(chat.neighbours(spark.createDataFrame([], SCHEMA))).count() == 0
