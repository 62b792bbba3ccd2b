import random

import pytest
from pyspark.sql import functions as F

from annalist import journal
from annalist.functions import passages
from annalist.functions import words as W
from annalist.operators import change, eligibility, extract, packing, report, search, similarity, validate
from annalist.streaming import consolidate

FACT = "id string, entity_id string, path string, ord long, title string, aliases array<string>, statement string, status string, visibility string, entity_visibility string, valid_from timestamp, valid_to timestamp, expires_at timestamp, source_ids array<string>, supersedes array<string>"


def facts(spark, rows):
    fill = {"entity_id": "w_a", "path": "memory/workstreams/a.md", "ord": 1, "title": "", "aliases": [], "status": "active", "visibility": "private", "entity_visibility": "private", "source_ids": [], "supersedes": []}
    names = [f.split()[0] for f in FACT.split(", ")]
    return spark.createDataFrame([tuple((fill | r).get(n) for n in names) for r in rows], FACT)


EVENT = "event_id string, seq long, scope_id string, session_id string, role string, source_kind string, source_id string, custom_kind string, content string, project string, metadata string"


def events(spark, said, **same):
    fill = {"scope_id": "personal", "session_id": "s", "role": "user", "source_kind": "chat", "project": None, "metadata": None} | same
    names = [f.split()[0] for f in EVENT.split(", ")]
    rows = [fill | {"event_id": f"evt_chat_{k}", "source_id": f"{k}", "seq": k + 1, "content": s} if isinstance(s, str) else fill | {"event_id": f"evt_chat_{k}", "source_id": f"{k}", "seq": k + 1} | s for k, s in enumerate(said)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], EVENT)


def test_rare_words_lead_and_prefixes_count_for_less(spark):
    f = facts(spark, [{"id": str(k), "ord": k, "statement": s} for k, s in enumerate(["the license is MIT", "licenced software here", "the build is fast", "the tests are green"])])
    found = search.search_facts(f, "the license", 5).collect()
    assert [r.id for r in found][:2] == ["0", "1"]
    assert found[0].score > found[1].score > 0
    assert {r.id for r in found} == {"0", "1", "2", "3"}  # a stopword still matches, barely


def test_events_that_repeat_the_word_come_first(spark):
    e = events(spark, ["deploy deploy deploy now", "we deploy", "nothing here", "DEPLOYMENT plan", "other"])
    found = search.search_events(e, "deploy", 10).collect()
    assert [r.seq for r in found] == [1, 2, 4]


def test_equal_scores_go_by_seq(spark):
    e = events(spark, ["same word"] * 5)
    assert [r.seq for r in search.search_events(e, "word", 3).collect()] == [1, 2, 3]


def test_metadata_is_searched_too(spark):
    e = events(spark, [{"content": "x", "metadata": '{"choice":"zebra"}'}, "y"])
    assert [r.seq for r in search.search_events(e, "zebra", 3).collect()] == [1]


def test_short_siblings_of_clipped_hits(spark):
    long = {"content": "needle " * 500, "event_id": "evt_chat_a"}
    rows = [long, {"content": "Prompt is too long, sorry", "event_id": "evt_chat_a"}, {"content": "ok", "event_id": "evt_chat_a"}, {"content": "a different conversation", "event_id": "evt_chat_b"}]
    e = events(spark, rows)
    found = search.search_events(e, "needle", 5, True).collect()
    assert [(r.seq, r.score > 0) for r in found] == [(1, True), (2, False)]
    assert [r.seq for r in search.search_events(e, "needle", 5).collect()] == [1]


def test_interleaved_and_limited(spark):
    f = facts(spark, [{"id": f"f{k}", "ord": k, "statement": f"needle number {k}"} for k in range(3)])
    e = events(spark, ["needle one", "needle two", "needle three", "needle four"])
    ids = [r.id for r in search.combined(f, e, "needle", 5).orderBy("place").collect()]
    assert [i.startswith("journal:") for i in ids] == [False, True, False, True, False]
    assert [r.id for r in search.combined(f, None, "needle", 5).orderBy("place").collect()] == ["f0", "f1", "f2"]


def test_project_filter_comes_after_the_top_facts(spark):
    f = facts(spark, [{"id": f"a{k}", "entity_id": "w_other", "ord": k, "statement": "needle needle"} for k in range(25)] + [{"id": "mine", "entity_id": "w_app_2", "path": "z", "ord": 99, "statement": "needle"}])
    keep = eligibility.project_entities("App")
    assert search.combined(f, None, "needle", 20, keep=keep).count() == 0
    assert [r.id for r in search.combined(f.filter(keep), None, "needle", 20).collect()] == ["mine"]


def test_rerankers(spark):
    f = facts(spark, [{"id": f"f{k}", "ord": k, "statement": f"needle {'good' if k == 2 else 'bad'}"} for k in range(4)])
    judge = search.judge_reranker(lambda q, s: (3.0, 1.0) if "good" in s else (0.0, 1.0))
    assert search.combined(f, None, "needle", 3, judge).orderBy("place").first().id == "f2"
    model = search.model_reranker(lambda q, s: 2.0 if "good" in s else -2.0)
    assert search.combined(f, None, "needle", 3, model).orderBy("place").first().id == "f2"
    declining = search.model_reranker(lambda q, s: -9.0 - len(s))
    assert [r.id for r in search.combined(f, None, "needle", 4, declining).orderBy("place").collect()] == ["f0", "f1", "f2", "f3"]

    def broken(query, baseline, limit):
        raise RuntimeError("no model")

    assert search.combined(f, None, "needle", 3, search.first_that_answers([broken, judge])).orderBy("place").first().id == "f2"
    assert search.combined(f, None, "needle", 3, search.first_that_answers([broken])).count() == 3

    def fails(query, statement):
        raise RuntimeError("no answer")

    late = search.judge_reranker(fails)
    assert search.combined(f, None, "needle", 3, search.first_that_answers([late, judge])).orderBy("place").first().id == "f2"
    assert [r.id for r in search.combined(f, None, "needle", 3, search.first_that_answers([late])).orderBy("place").collect()] == ["f0", "f1", "f2"]


def test_short_quotes_are_found_within_tokens(spark):
    texts = ["the bluebird sings loudly", "Bluebirds sing", "a bird sings", "sing blue bird", "of bluebirdsong"]
    quotes = ["bluebird", "uebird sing", "bird sings", "blue bird s", "the bluebird sings", "loudly x", "a bird s", "uebirdson", "bird sin"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc long, said string")
    q = spark.createDataFrame(list(enumerate(quotes)), "item long, quote string")
    found = {(r.doc, r.item) for r in extract.contained(d, q, "said", "quote").collect()}
    assert found == {(i, k) for i, t in enumerate(texts) for k, x in enumerate(quotes) if x in t.lower()}
    assert extract.contained(d, q, "said", "quote").count() == len(found)


def test_a_model_sees_the_same_batches_however_rows_are_dealt(spark):
    rows = spark.createDataFrame([(k, 0, "x" * 3000) for k in range(12)], "seq long, k int, said string")
    client = lambda batch: [{"ref": b["ref"], "lasting": True, "statement": str([x["ref"] for x in batch])} for b in batch]
    calls = [sorted((r.ref, r.statement) for r in extract.model_proposals(rows.repartition(n), client).collect()) for n in (1, 5)]
    assert calls[0] == calls[1] and len({s for _, s in calls[0]}) == 3


@pytest.fixture
def small_ranges(spark):
    """Ranges stay as they are dealt, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("most", [1, 7, 40])
def test_packs_are_those_of_one_pass(spark, most, small_ranges):
    """Over ranges of rows, with rows beyond the bound, empty ones and ties in size."""
    draw = random.Random(most)
    sizes = [draw.choice([0, 1, 2, 3, 9, 50]) for _ in range(300)]
    rows = spark.createDataFrame([(k, n, "x") for k, n in enumerate(sizes)], "seq long, n long, pack_of string").repartition(7)
    found = packing.packs(rows, ["seq"], F.col("n"), most).collect()
    wanted = [(k, p) for p, own in enumerate(passages.packed(range(300), lambda k: sizes[k], most)) for k in own]
    assert sorted((r.seq, r.pack) for r in found) == wanted
    assert packing.packs(rows.limit(0), ["seq"], F.col("n"), most).count() == 0


def test_a_client_is_told_what_is_known(spark):
    rows = spark.createDataFrame([(1, 0, "x" * 9)], "seq long, k int, said string")
    client = lambda batch, told: [{"ref": batch[0]["ref"], "statement": told[0]["title"]}]
    assert [r.statement for r in extract.model_proposals(rows, client, [{"title": "Ann"}]).collect()] == ["Ann"]


def test_rows_fall_by_either_key_only_beside_kept_ones(spark):
    draw = random.Random(4)
    rows = [(k, draw.choice([None, *"abcdefghij"]), draw.choice([None, *range(12)])) for k in range(40)]
    rows += [(100, "p", 100), (101, "q", 100), (102, "q", 102), (103, "q", 102), (104, None, None), (105, None, None)]
    kept, seen = [], (set(), set())
    for n, a, b in rows:
        if a not in seen[0] and b not in seen[1]:
            kept.append(n)
            seen[0].update({a} - {None})
            seen[1].update({b} - {None})
    frame = spark.createDataFrame(rows, "n long, id string, key long").repartition(3)
    assert sorted(r.n for r in journal.first_kept(frame, ["n"], "id", "key").collect()) == kept
    assert 102 in kept and 101 not in kept  # one pass for each key would drop 102
    assert journal.first_kept(frame.limit(0), ["n"], "id", "key").count() == 0


def test_an_export_is_written_in_ordered_parts(spark, tmp_path, small_ranges):
    rows = [{"id": f"f{k}", "entity_id": e, "ord": k, "statement": f"s{k}"} for k in range(30) for e in ("w_a", "pref_user")]
    f = facts(spark, [r | {"id": f"{r['id']}{r['entity_id']}", "source_ids": ["evt_chat_1"]} for r in rows])
    lines = report.export_lines(f)
    index = sorted(report.write_export(lines, f"{tmp_path}/out").collect(), key=lambda r: r.part)
    written = "".join((tmp_path / "out" / "lines" / r.part).read_text() for r in index)
    assert report.export_text("T", lines) == f"# T memory\n\n{written}\n"
    assert sum(r.bytes for r in index) == len(written.encode()) and len(index) > 1
    sections = report.export_sections(f).orderBy("rank", "heading").collect()
    assert written == "\n".join(f"## {r.heading}\n\n" + "".join(f"{x}\n" for x in r.lines) for r in sections)
    assert report.export_text("T", report.export_lines(f.limit(0))) == "# T memory\n\n> No active facts yet.\n"


@pytest.mark.parametrize(
    "change_, shown",
    [({}, True), ({"status": "superseded"}, False), ({"status": "disputed"}, False), ({"expires_at": "2024-06-01"}, False), ({"valid_to": "2024-06-02"}, True), ({"valid_from": "2024-06-02"}, False), ({"visibility": "public"}, True)],
)
def test_eligibility(spark, change_, shown):
    from datetime import datetime

    row = {k: datetime.fromisoformat(v) if k in ("expires_at", "valid_to", "valid_from") else v for k, v in change_.items()}
    f = facts(spark, [{"id": "x", "statement": "s"} | row])
    none = spark.createDataFrame([], "control string, target string")
    assert (eligibility.eligible_facts(f, none, F.lit("2024-06-01").cast("timestamp")).count() == 1) is shown


def test_controls_hide(spark):
    f = facts(spark, [{"id": i, "statement": "s"} for i in "abcd"])
    controls = spark.createDataFrame([("suppressed", "a"), ("retracted", "b"), ("deleted", "c")], "control string, target string")
    assert {r.id for r in eligibility.uncontrolled(f, controls).collect()} == {"d"}
    assert {r.id for r in eligibility.readable_facts(f, controls).collect()} == {"b", "d"}


def words(statement):
    import re

    return {search.stem(w) for w in re.split(r"[^\w]+|_", statement.lower()) if w and w not in W.RESTATEMENT_STOPWORDS}


def alike(a, b):
    both = len(a & b)
    return both > 0 and (both >= 0.6 * len(a | b) or (min(len(a), len(b)) >= 3 and both >= 0.75 * min(len(a), len(b))))


def statements(seed, n=60):
    draw = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(14)]
    return [(f"f{k:02}", draw.choice(["w_a", "w_a_2", "w_b", "pref_user"]), " ".join(draw.sample(vocabulary, draw.randint(1, 7)))) for k in range(n)]


def family(e):
    return e[:-2] if e.endswith("_2") else e


@pytest.mark.parametrize("seed", range(3))
def test_matches_are_all_pairs_that_fit(spark, seed):
    rows = statements(seed)
    found = {(r.a, r.b) for r in similarity.matches(spark.createDataFrame(rows, "id string, entity_id string, statement string")).collect()}
    related = lambda x, y: family(x) == family(y) or "pref_user" in (family(x), family(y))
    assert found == {(a, b) for a, ea, sa in rows for b, eb, sb in rows if a < b and related(ea, eb) and alike(words(sa), words(sb))}


@pytest.mark.parametrize("seed", range(4))
def test_duplicates_are_those_of_the_greedy_loop(spark, seed):
    rows = statements(seed)
    kept, wanted = [], {}
    for i, e, s in sorted(rows, key=lambda r: (-len(r[2].encode()), r[0])):
        first = next((k for k, ke, ks in kept if (family(ke) == family(e) or family(ke) == "pref_user") and alike(words(s), words(ks))), None)
        if first is None:
            kept.append((i, e, s))
        else:
            wanted[i] = first
    found = similarity.duplicates(spark.createDataFrame(rows, "id string, entity_id string, statement string").repartition(3))
    assert {r.id: r.duplicate_of for r in found.collect()} == wanted


@pytest.mark.parametrize("seed", range(3))
def test_placeable_are_those_of_the_greedy_loop(spark, seed):
    rows = statements(seed, 50)
    old, new = rows[:15], rows[15:]
    blocked = {new[3][0], new[9][0]}
    have = list(old)
    wanted = set()
    for i, e, s in new:
        if i in blocked:
            continue
        near = [x for x in have if family(x[1]) == family(e) or family(x[1]) == "pref_user" or (family(e) == "pref_user" and x[1].startswith("w_"))]
        if not any(alike(words(s), words(x[2])) for x in near):
            have.append((i, e, s))
            wanted.add(i)
    schema = "id string, entity_id string, statement string"
    proposals = spark.createDataFrame([(*r, k) for k, r in enumerate(new)], schema + ", order long")
    found = similarity.placeable(proposals, spark.createDataFrame(old, schema), spark.createDataFrame([(b,) for b in blocked], "target string"))
    assert {r.id for r in found.collect()} == wanted


def test_rules(spark):
    e = events(spark, ["Hi, my name is Ada. I live in Paris.", "please always use tabs.", "nothing", {"content": "my name is Bob", "role": "assistant"}])
    found = [(r.seq, r.entity_id, r.statement) for r in extract.rule_proposals(e).orderBy("seq", "k").collect()]
    assert found == [(1, "p_ada", "User's name is Ada."), (1, "p_user", "User lives in Paris."), (2, "pref_user", "User requested: use tabs")]
    assert {r.reason: r.seqs for r in extract.by_reason(extract.dispositions(e)).collect()} == {"not a user statement": [4], "no high-confidence pattern matched": [3]}


def test_model_gate(spark):
    e = events(spark, ["We always deploy with the blue script on Fridays."], project="/work/Shop")

    def client(batch):
        one = {"ref": 1, "lasting": True, "entity_type": "project", "entity_name": "x", "predicate": "deploy rule", "statement": "Deploys use the blue script.", "evidence": "deploy with the blue script"}
        return [one, one | {"evidence": "never said at all"}, one | {"lasting": False}, one | {"ref": 99}, one | {"entity_type": "person", "entity_name": "p_Ann Lee", "statement": "Ann deploys."}]

    known = spark.createDataFrame([], "entity_id string, title string")
    found = extract.gated(extract.model_proposals(extract.candidates(e), client), e, known).collect()
    assert sorted((r.entity_id, r.predicate, r.reason or "") for r in found) == [
        ("p_ann_lee", "deploy_rule", ""), ("w_shop", "deploy_rule", ""), ("w_shop", "deploy_rule", "evidence not found in the cited event"), ("w_shop", "deploy_rule", "not lasting (true for one session only)")
    ]


def test_outdated_file_facts(spark):
    notes = events(spark, [{"content": "x", "role": "note", "event_id": "evt_ide_md:/a/AGENTS.md:new"}])
    f = facts(spark, [{"id": "old", "source_ids": ["evt_ide_md:/a/AGENTS.md:v1"]}, {"id": "new", "source_ids": ["evt_ide_md:/a/AGENTS.md:new"]}, {"id": "both", "source_ids": ["evt_ide_md:/a/AGENTS.md:v1", "evt_chat_1"]}, {"id": "none"}])
    assert [r.id for r in extract.outdated(f, notes).collect()] == ["old"]


def test_changes(spark):
    f = facts(spark, [{"id": "a", "statement": "one"}, {"id": "b", "statement": "two", "status": "superseded"}])
    new = facts(spark, [{"id": "b", "statement": "again"}, {"id": "c", "statement": "three"}])
    assert {(r.id, r.statement, r.status) for r in change.upserted(f, new).collect()} == {("a", "one", "active"), ("b", "again", "active"), ("c", "three", "active")}
    out = {r.id: (r.status, r.supersedes) for r in change.superseded(f, spark.createDataFrame([("a", "c")], "id string, new_id string")).collect()}
    assert out["a"] == ("superseded", ["c"]) and out["b"] == ("superseded", [])
    controls = spark.createDataFrame([("suppressed", "x")], "control string, target string")
    after = change.forgotten(controls, spark.createDataFrame([("a",), ("x",)], "id string"))
    assert after.count() == 4 and [r.id for r in change.pruned(f, after).collect()] == ["b"]


def test_spill_files():
    assert change.homes([], "w_a", [100, 55_000, 100, 60_000]) == ["w_a", "w_a_2", "w_a", None]
    assert change.homes([("w_a", 56_000)], "w_a", [10]) == ["w_a_2"]
    full = [("w_a", 56_000), *((f"w_a_{k}", 56_000) for k in range(2, 51))]
    assert change.homes(full, "w_a", [10]) == [None]


def test_a_short_fact_after_many_that_fit_nowhere_is_placed(spark):
    sizes = [("w_a", 56_000 - 700), *((f"w_a_{k}", 56_000) for k in range(2, 51))]
    rows = [(f"a{k}", "w_a", "x" * 200, k) for k in range(5000)] + [("late", "w_a", "short", 5000), ("more", "w_a", "short", 5001)]
    rows += [(f"b{k}", "w_b", "y" * (k * 7919 % 3000), k) for k in range(11_000)] + [("c", "w_c", "z" * 60_000, 1), ("d", "w_c", "z", 2)]
    own = {}
    for entity in ("w_a", "w_b", "w_c"):
        mine = [r for r in rows if r[1] == entity]
        found = change.homes(sizes if entity == "w_a" else [], entity, [len(r[2]) for r in mine])
        own |= {r[0]: h for r, h in zip(mine, found, strict=True) if h is not None}
    assert own["late"] == "w_a" and "more" not in own
    files = spark.createDataFrame([(e, "w_a", n) for e, n in sizes], "entity_id string, family string, bytes long")
    found = change.placed(spark.createDataFrame(rows, "id string, entity_id string, statement string, order long"), files).collect()
    assert len(found) == len(own) and {r.id: r.home for r in found} == own


def test_scrubbing_needs_the_whole_id(spark):
    lines = spark.createDataFrame([("[fact_1] x",), ("[fact_12] y",), ("z",), (None,)], "line string")
    needles = spark.createDataFrame([("fact_1",)], "needle string")
    assert [r.line for r in change.scrubbed(lines, needles, "line").collect()] == ["[fact_12] y", "z", None]


def test_index_budget(spark):
    counts = spark.createDataFrame([(f"p_{k:04}", "person", "t" * 50, k % 3) for k in range(100)], "entity_id string, entity_type string, title string, active long")
    rows = report.index_rows(counts, 1000).orderBy("k").collect()
    assert len(report.INDEX_HEAD) + sum(len(r.line.encode()) for r in rows[:-1]) <= 1000
    assert rows[-1].line == f"- … and {100 - len(rows) + 1} more entities\n"
    assert rows[1].line.endswith("1 active fact\n")
    assert report.index_rows(counts).count() == 100


def test_managed_block():
    first = report.spliced("# Mine\n", "body\n")
    assert first.startswith("# Mine\n\n<!-- memory:begin") and report.spliced(first, "body\n") == first
    assert "old" not in report.spliced(report.spliced("a", "old\n"), "new\n")
    assert report.spliced(None, "b\n").count("memory:begin") == 1 and report.spliced("a\n\n", "b\n").startswith("a\n\n<!--")


def test_timings_take_the_nearest_index(spark):
    rows = spark.createDataFrame([("q", float(v)) for v in (5, 1, 4, 2)], "q string, ms double")
    assert tuple(report.timings(rows, ["q"]).first())[1:] == (4, 1.0, 4.0, 5.0)


def test_case_scores(spark):
    cases = spark.createDataFrame([("a", "x", ["f1", "f2"], ["Blue"], ["red"]), ("b", "x", ["f9"], [], []), ("c", "y", [], [], [])], "case_id string, category string, expected array<string>, must_include array<string>, must_not_include array<string>")
    hits = spark.createDataFrame([("a", 1, "f3", "the blue one"), ("a", 2, "f2", "two"), ("a", 3, "f1", "three"), ("b", 1, "f1", "x")], "case_id string, place long, id string, statement string")
    found = {r.case_id: r for r in report.case_scores(cases, hits).collect()}
    assert found["a"].passed and found["a"].first_expected_rank == 2
    assert not found["b"].recall and found["b"].first_expected_rank is None and found["c"].passed
    total = report.run_report(report.case_scores(cases, hits)).first()
    assert (total.total, total.passed, round(total.recall, 3)) == (3, 2, 0.667)


def test_framed_logs(spark):
    whole = "2\nab\n3\né1\n1\nx\n"
    rows = [("a", whole), ("b", whole[:-3]), ("c", "2\nab\nzz\nx\n1\ny\n"), ("d", "")]
    found = journal.framed(spark.createDataFrame(rows, "file string, content string")).orderBy("file", "k").collect()
    assert [(r.file, r.body) for r in found] == [("a", "ab"), ("a", "é1"), ("a", "x"), ("b", "ab"), ("b", "é1"), ("c", "ab")]


def test_numbers_are_consecutive(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("at"), F.concat(F.lit("e"), "id").alias("event_id")).repartition(5)
    found = journal.numbered(rows, 40, ["at"]).orderBy("at").collect()
    assert [r.seq for r in found] == list(range(41, 1041))


def test_windows_cover_the_log(spark):
    e = spark.range(1, 95).select((F.col("id") * 2).alias("seq"))
    found = consolidate.windows(e, 10, 20).orderBy("batch").collect()
    assert [r.events for r in found] == [20, 20, 20, 20, 9]
    assert found[0].from_seq == 12 and found[-1].through_seq == 188
    assert consolidate.next_window(e, 10, 20) == found[0].through_seq and consolidate.next_window(e, 500, 20) is None


def test_bad_change_sets(spark):
    good = spark.createDataFrame([("memory/people/a.md", "x"), ("state/controls.json", "{}")], "path string, content string")
    assert validate.bad_changes(good).count() == 0
    bad = spark.createDataFrame([("x/memory/people/a.md", "x"), ("state/controls.json", "{"), ("INDEX.md", "a"), ("INDEX.md", "b"), ("PROFILE.md", "y" * 70_000)], "path string, content string")
    assert {(r.path, r.reason) for r in validate.bad_changes(bad).collect()} == {("x/memory/people/a.md", "path"), ("state/controls.json", "json"), ("INDEX.md", "twice"), ("PROFILE.md", "size")}
    assert [r.reason for r in validate.bad_changes(good.limit(0)).collect()] == ["files"]


def test_prompts(spark):
    f = facts(spark, [{"id": "a", "ord": 1, "statement": "Deploy scripts live in tools"}, {"id": "b", "ord": 2, "statement": "Deploy only"}])
    assert [r.id for r in search.prompt_facts(f, "where do deploy scripts live").collect()] == ["a"]
    assert search.prompt_facts(f, "/deploy scripts now").count() == 0 and search.prompt_facts(f, "deploy scripts").count() == 0


def test_known_entities_fit_their_budget(spark):
    f = facts(spark, [{"id": f"{k}-{n}", "entity_id": f"w_{k:03}", "ord": n, "title": "t", "statement": "s" * 300} for k in range(4) for n in range(10)])
    known = extract.known_entities(f)
    assert [e["id"] for e in known] == ["w_000", "w_001", "w_002", "w_003"]
    assert sum(len(s) for e in known for s in e["facts"]) <= extract.KNOWN_BYTES


def test_timings_equal_sorting_each_group(spark):
    import random

    draw = random.Random(4)
    rows = [(draw.choice("abcde"), draw.choice((None, 1.5, 2.0, draw.random() * 9))) for _ in range(400)] + [("none", None), (None, 3.0), ("one", 7.0)] + [("hot", float(k % 5)) for k in range(500)]
    groups = {}
    for q, ms in rows:
        groups.setdefault(q, []).append(ms)
    wanted = {}
    for q, values in groups.items():
        v = sorted(x for x in values if x is not None)
        wanted[q] = (len(v), *(v[int((len(v) - 1) * p + 0.5)] if v else None for p in (0.0, 0.5, 0.95)))
    found = report.timings(spark.createDataFrame(rows, "q string, ms double").repartition(5), ["q"])
    assert {r.q: tuple(r)[1:] for r in found.collect()} == wanted
    assert report.timings(spark.createDataFrame([], "q string, ms double"), ["q"]).count() == 0
