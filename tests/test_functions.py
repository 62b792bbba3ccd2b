import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalist.functions import passages, text
from annalist.operators import search


def column(spark, values, made):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[1] for r in frame.select("k", made(F.col("v")).alias("o")).orderBy("k").collect()]


WORDS = ["agents", "deployed", "pushes", "changes", "class", "boxes", "ring", "red", "matches", "uses", "Testing", "bus", "glasses", "és", "naïves"]


def test_stems_of_rows_are_those_of_queries(spark):
    assert column(spark, WORDS, text.stem) == [search.stem(w) for w in WORDS]
    assert [search.stem(w) for w in WORDS[:9]] == ["agent", "deploy", "push", "change", "class", "box", "ring", "red", "match"]


def test_tokens(spark):
    said = ["Hello, big-World_x  9é!", "", "--", "a.b"]
    assert column(spark, said, text.tokens) == [["hello", "big-world_x", "9é"], [], ["--"], ["a", "b"]]
    assert [search.tokens(s) for s in said] == [["hello", "big-world_x", "9é"], [], ["--"], ["a", "b"]]


def test_prefix_counts_bytes(spark):
    assert column(spark, ["license", "four", "ééé", "abcdé"], text.prefix) == ["licen", None, None, None]


def test_slug(spark):
    assert column(spark, ["  My App!! ", "a" * 70, "x_" * 40, "é"], text.slug) == ["my_app", "a" * 60, ("x_" * 30).rstrip("_"), ""]


@pytest.mark.parametrize(
    "said, kept",
    [
        ("<system-reminder>hidden\nx</system-reminder>keep this", "keep this"),
        ("<command-name>go</command-name><command-args> do it </command-args>", "do it"),
        ("<skill>only this</skill>", None),
        ("# AGENTS.md instructions for x", None),
        ("look [Image #1] here\n/tmp/a.png\nend", "look  here\nend"),
        ("plain", "plain"),
    ],
)
def test_own_words(spark, said, kept):
    assert column(spark, [said], text.own_words) == [kept]


def test_normalised_is_the_same_for_rows_and_strings(spark):
    said = ["- **Bold** `x`\n  12. “q” — it’s", "+ a\n\n# B  c", "1.5 is 2. x"]
    assert column(spark, said, text.normalised) == [passages.normalise(s) for s in said] == ['bold x "q" - it\'s', "a b c", "1.5 is 2. x"]


@pytest.mark.parametrize(
    "source, quote, found",
    [
        ("The build uses **pnpm** and `vite`.", "build uses pnpm and vite", True),
        ("first part here, then much more, last part here", "first part here … last part here", True),
        ("first part here, last part here", "last part here... first part here", False),
        ("anything", "short", False),
        ("It’s “quoted” text", "it's \"quoted\" text", True),
    ],
)
def test_quotes(source, quote, found):
    assert passages.quoted(source, quote) is found


def test_snippets():
    said = " ".join(f"w{k}" for k in range(30))
    assert passages.snippet(said, ["w20"], 5) == "... w18 w19 w20 w21 w22 ..."
    assert passages.snippet(said, ["w0"], 5) == "w0 w1 w2 w3 w4 ..."
    assert passages.snippet(said, ["w29"], 5) == "... w25 w26 w27 w28 w29"
    assert passages.snippet("a b", ["b"], 5) == "a b" and passages.snippet(said, [], 0) == ""


def test_excerpts_keep_whole_characters():
    said = "é" * 300 + "needle" + "ü" * 300
    found = passages.excerpt(said, ["NEEDLE"])
    assert "needle" in found and found.startswith("... ") and found.endswith(" ...")
    assert passages.excerpt("short", ["x"]) == "short"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40))
def test_pieces_lose_nothing(said, most):
    found = passages.chunks(said, most)
    assert all(len(p) <= most + 1 for p in found)
    if said.strip():
        assert "".join(found).replace("\n", "").strip() == said.replace("\n", "").strip()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=30), st.integers(10, 50))
def test_batches_do_not_pass_their_size(sizes, most):
    found = list(passages.packed(iter(sizes), lambda n: n, most))
    assert [n for own in found for n in own] == sizes
    assert all(sum(own) <= most or len(own) == 1 for own in found)
    assert all(sum(a) + b[0] > most for a, b in zip(found, found[1:]))


def test_first_lines(spark):
    assert column(spark, ["a\n\n b \nc", "\n \n", "x"], lambda c: text.first_lines(c, 2)) == ["a\nb\n...", "", "x"]


def test_ids(spark):
    made = spark.range(1).select(text.fact_id(F.lit("p_a"), F.lit("name"), F.lit("X Y")).alias("f")).first().f
    again = spark.range(1).select(text.fact_id(F.lit("p_a"), F.lit("name"), F.lit("x y")).alias("f")).first().f
    assert made == again and made.startswith("fact_") and len(made) == 17


def test_families_and_paths(spark):
    ids = ["w_app_2", "w_app", "pref_user_10", "p_2", "c_x", "o_y"]
    assert column(spark, ids, text.family) == ["w_app", "w_app", "pref_user", "p_2", "c_x", "o_y"]
    assert column(spark, ids, text.entity_path) == [f"memory/{x}.md" for x in ("workstreams/app_2", "workstreams/app", "preferences/user_10", "people/2", "conversations/x", "orgs/y")]


def test_cue_times(spark):
    assert column(spark, ["00:00:01.500", "01:02:03", "00:00:01,5", "x"], text.cue_offset) == [1500, 3723000, None, None]


def test_condensed_queries():
    assert search.condense("short query") == "short query"
    long = "the connection of servers " * 20 + "unique"
    assert search.condense(long) == "connection servers unique"
    assert len(search.condense(" ".join(f"word{k}" for k in range(100)))) <= 200


@pytest.mark.parametrize("query, limit", [("", 5), (" ", 5), ("x" * 201, 5), ("x", 0), ("x", 21)])
def test_bad_queries(query, limit):
    with pytest.raises(ValueError):
        search.checked(query, limit)
