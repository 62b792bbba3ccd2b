"""Reports: status, index, export, evaluation, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text
from annalist.journal import numbered
from annalist.operators.digests import ordered_md5
from annalist.storage import cut

INDEX_HEAD, INDEX_BYTES = "# Memory index\n\n", 60_000


def status(events: DataFrame, facts: DataFrame, through_seq: int) -> DataFrame:
    """One row: events, last seq, projects, entities, active facts and the lag behind the log (never negative)."""
    e = events.agg(F.count("*").alias("events"), F.coalesce(F.max("seq"), F.lit(0)).alias("last_seq"), F.count_distinct(text.project_name(F.col("project"))).alias("projects"))
    f = facts.agg(F.count_distinct("entity_id").alias("entities"), F.count_if(F.col("status") == "active").alias("active_facts"))
    return e.crossJoin(f).withColumn("lag", F.greatest(F.col("last_seq") - through_seq, F.lit(0)))  # two rows of one


def entity_counts(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(entity_id, entity_type, title, active): active facts of every entity, none included."""
    active = facts.filter("status = 'active'").groupBy("entity_id").agg(F.count("*").alias("n"))
    return entities.select("entity_id", "entity_type", "title").join(active, "entity_id", "left").select("entity_id", "entity_type", "title", F.coalesce("n", F.lit(0)).alias("active"))


def index_rows(counts: DataFrame, budget: int = INDEX_BYTES) -> DataFrame:
    """(k, line): a line for each entity in order of id while the budget of bytes lasts, then how many are left.

    A file of bounded size needs one order over all entities; their lines are cut to the budget
    before they are numbered, so that the sort keeps a bounded number of them.
    """
    line = F.concat(
        F.lit("- `"), "entity_id", F.lit("` ("), "entity_type", F.lit(") "), "title", F.lit(" — "), F.col("active").cast("string"),
        F.when(F.col("active") == 1, " active fact").otherwise(" active facts"), F.lit("\n"),
    )
    total = counts.agg(F.count("*").alias("entities"))
    # Each line has over twenty bytes, so no more than budget / 20 can be listed.
    first = counts.withColumn("line", line).orderBy("entity_id").limit(budget // 20 + 1)
    order = Window.orderBy("entity_id")
    upto = F.sum(F.octet_length("line")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + len(INDEX_HEAD)
    listed = first.select(F.row_number().over(order).alias("k"), "line", upto.alias("upto")).filter(F.col("upto") <= budget)
    rest = listed.agg(F.count("*").alias("listed")).crossJoin(total).filter("entities > listed")
    tail = rest.select((F.col("listed") + 1).cast("int").alias("k"), F.concat(F.lit("- … and "), (F.col("entities") - F.col("listed")).cast("string"), F.lit(" more entities\n")).alias("line"))
    return listed.select("k", "line").unionByName(tail)


def overlaid(base: DataFrame, updates: DataFrame) -> DataFrame:
    """``base`` by path after ``updates``: a row replaces, a row with ``deleted`` removes."""
    u = updates.select(F.col("path").alias("u_path"), "deleted", *(F.col(c).alias(f"u_{c}") for c in base.columns if c != "path"))
    both = base.join(u, F.col("path") == F.col("u_path"), "full_outer").filter(~F.coalesce("deleted", F.lit(False)))
    new = F.col("u_path").isNotNull()
    return both.select(F.coalesce("path", "u_path").alias("path"), *(F.when(new, F.col(f"u_{c}")).otherwise(F.col(c)).alias(c) for c in base.columns if c != "path"))


def _export_rows(facts: DataFrame, include_file_facts: bool, keep: Column | None) -> DataFrame:
    """(rank, heading, path, ord, line) of what an export shows."""
    from annalist.operators.eligibility import from_files_only

    shown = facts.filter(F.col("status").isin("active", "disputed"))
    shown = shown if include_file_facts else shown.filter(~from_files_only())
    shown = shown.filter(keep) if keep is not None else shown
    tag = F.when(F.col("visibility").isin("shared", "public"), F.concat(F.lit(" _("), "visibility", F.lit(")_"))).otherwise("")
    line = F.concat(F.lit("- ["), "id", F.lit("] "), "statement", tag)
    folder = text.bucket(F.col("entity_id"))
    return shown.select(text.heading_order(folder).alias("rank"), text.heading(folder).alias("heading"), "path", "ord", line.alias("line"))


def export_sections(facts: DataFrame, include_file_facts: bool = False, keep: Column | None = None) -> DataFrame:
    """(rank, heading, lines): what an export shows under each heading, in order of entity and place; for exports that fit a row."""
    rows = _export_rows(facts, include_file_facts, keep).select("rank", "heading", F.struct("path", "ord", "line").alias("l"))
    return rows.groupBy("heading").agg(F.min("rank").alias("rank"), F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]).alias("lines"))


def export_digests(facts: DataFrame, include_file_facts: bool = False, keep: Column | None = None) -> DataFrame:
    """(heading, rank, n, md5): how many lines an export of any size shows under each heading, and the MD5 of these lines, joined by line feeds, in the order of ``export_sections``."""
    rows = _export_rows(facts, include_file_facts, keep)
    ranks = rows.groupBy("heading").agg(F.min("rank").alias("rank"))  # a handful of headings
    return ordered_md5(rows, "heading", ["path", "ord"], "line", "\n").join(F.broadcast(ranks), "heading").select("heading", "rank", "n", "md5")


def export_lines(facts: DataFrame, include_file_facts: bool = False, keep: Column | None = None) -> DataFrame:
    """(n, heading, k, line): an export of any size, its lines numbered from 1 over all and (k) within their heading.

    Headings that several folders share stand where the first of them does. Lines are numbered by ranges
    of their order, so that no heading, however large, is in one array or one task.
    """
    rows = _export_rows(facts, include_file_facts, keep)
    ranks = rows.groupBy("heading").agg(F.min("rank").alias("rank"))  # a handful of headings
    ordered = rows.drop("rank").join(F.broadcast(ranks), "heading")
    lines = cut(numbered(ordered, 0, ["rank", "heading", "path", "ord", "line"]))
    first = lines.groupBy("heading").agg(F.min("seq").alias("_first"))
    return lines.join(F.broadcast(first), "heading").select(F.col("seq").alias("n"), "heading", (F.col("seq") - F.col("_first") + 1).alias("k"), "line")


def _with_headings(lines: DataFrame) -> DataFrame:
    """(n, value): lines of a file, each heading's before its first one."""
    gap = F.when(F.col("n") > 1, "\n").otherwise("")
    return lines.select("n", F.concat(F.when(F.col("k") == 1, F.concat(gap, F.lit("## "), "heading", F.lit("\n\n"))).otherwise(""), "line").alias("value"))


def write_export(lines: DataFrame, folder: str) -> DataFrame:
    """Write ``export_lines`` as text files whose names are in the order of their lines; (part, lines, bytes) of each file, in ``folder``/index too."""
    spark = lines.sparkSession
    _with_headings(lines).repartitionByRange("n").sortWithinPartitions("n").select("value").write.text(f"{folder}/lines")
    found = spark.read.text(f"{folder}/lines").select(F.col("_metadata.file_name").alias("part"), (F.octet_length("value") + 1).alias("size"))
    found.groupBy("part").agg(F.count("*").alias("lines"), F.sum("size").alias("bytes")).write.json(f"{folder}/index")
    return spark.read.schema("part string, lines long, bytes long").json(f"{folder}/index")


BEGIN, END = "<!-- memory:begin (generated; edits inside are replaced) -->", "<!-- memory:end -->"


def spliced(current: str | None, body: str) -> str:
    """A file with its managed block replaced, or with one appended after a blank line."""
    block = f"{BEGIN}\n{body}{END}"
    if current is None:
        return f"{block}\n"
    start, stop = current.find("<!-- memory:begin"), current.find(END)
    if 0 <= start < stop:
        return current[:start] + block + current[stop + len(END) :]
    gap = "" if not current or current.endswith("\n\n") else "\n" if current.endswith("\n") else "\n\n"
    return f"{current}{gap}{block}\n"


def export_text(title: str, lines: DataFrame) -> str:
    """An export, of ``export_lines``, as one Markdown text."""
    body = "".join(f"{r.value}\n" for r in _with_headings(lines).orderBy("n").toLocalIterator())
    return f"# {title} memory\n\n" + (f"{body}\n" if body else "> No active facts yet.\n")


def case_scores(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Each case of a rubric against its hits (case_id, place, id, statement).

    Passed: all expected ids are found, all texts that must be included are, and none that must not.
    """
    found = hits.groupBy(F.col("case_id").alias("c")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "statement"))).alias("h"))
    rows = cases.join(found, F.col("case_id") == F.col("c"), "left")
    ids = F.coalesce(F.transform("h", lambda x: x["id"]), F.array().cast("array<string>"))
    said = F.lower(F.coalesce(F.array_join(F.transform("h", lambda x: x["statement"]), "\n"), F.lit("")))
    places = F.filter(F.transform("expected", lambda e: F.array_position(ids, e)), lambda p: p > 0)
    recall = F.size(F.array_except("expected", ids)) == 0
    includes = F.forall("must_include", lambda x: F.contains(said, F.lower(x)))
    excludes = ~F.exists("must_not_include", lambda x: F.contains(said, F.lower(x)))
    return rows.select("case_id", "category", recall.alias("recall"), includes.alias("includes_ok"), excludes.alias("excludes_ok"), (recall & includes & excludes).alias("passed"), F.array_min(places).alias("first_expected_rank"))


def run_report(scores: DataFrame) -> DataFrame:
    """One row: cases, those passed, and the share with full recall."""
    return scores.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.avg(F.col("recall").cast("double")).alias("recall"))


def timings(runs: DataFrame, by: list[str]) -> DataFrame:
    """Least, median and 95th percentile of ``ms``: the value at index round((n - 1) q) of the sorted ones, not interpolated.

    All rows are numbered in order of group and value by ranges, so that no group, however large, is in
    one array or one task; the three rows of each group are then picked by their numbers. Runs without
    ``ms`` do not count; a group of such runs only has no values.
    """
    rows = runs.select(*by, "ms", F.col("ms").isNull().alias("_none"))
    rows = cut(numbered(rows.withColumn("_row", F.monotonically_increasing_id()), 0, [*by, "_none", "ms", "_row"]))
    groups = rows.groupBy(*by).agg(F.count("ms").alias("runs"), F.min("seq").alias("_first"))
    names = {"min_ms": 0.0, "median_ms": 0.5, "p95_ms": 0.95}
    places = F.array(*(F.struct(F.lit(name).alias("name"), (F.col("_first") + F.floor((F.col("runs") - 1) * q + 0.5)).alias("seq")) for name, q in names.items()))
    wanted = groups.select(*by, "runs", F.explode(F.when(F.col("runs") > 0, places).otherwise(F.array(F.struct(F.lit("").alias("name"), F.lit(None).cast("long").alias("seq"))))).alias("at"))
    picked = wanted.select(*by, "runs", "at.name", "at.seq").join(rows.select("seq", "ms"), "seq", "left")
    return picked.groupBy(*by, "runs").agg(*(F.max(F.when(F.col("name") == name, F.col("ms"))).alias(name) for name in names))


def json_line(*columns: str) -> Column:
    """A record as a line of JSON."""
    return F.to_json(F.struct(*columns))


def text_line(*columns: str) -> Column:
    """A record as a line of text: what is known, set apart by spaces."""
    return F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))


def by_type(events: DataFrame, kind: str, seq: str, user: str, weight: Column) -> DataFrame:
    """(kind, n, last_seq, users, k): events of each kind, their last number, how many users, and a sum of what they hold."""
    return events.groupBy(kind).agg(F.count("*").alias("n"), F.max(seq).alias("last_seq"), F.count_distinct(user).alias("users"), F.sum(weight).alias("k"))


def repeated_statements(facts: DataFrame, statement: Column) -> DataFrame:
    """(entity_id, statement, n): statements that an entity holds more than once."""
    return facts.groupBy("entity_id", statement.alias("statement")).agg(F.count("*").alias("n")).filter("n > 1")


def current_of_entities(readable: DataFrame) -> DataFrame:
    """(entity_id, fact_id, facts): the first active fact of each entity and how many there are, of readable facts."""
    return readable.filter("status = 'active'").groupBy("entity_id").agg(F.min_by("id", "ord").alias("fact_id"), F.count("*").alias("facts"))


SESSION_FACTS = 20


def session_start(readable: DataFrame, entity: str) -> DataFrame:
    """(ord, id, statement, active_facts): what a session starts with: an entity's first facts, and how many facts are current in all."""
    live = readable.filter("status = 'active'")
    first = live.filter(F.col("entity_id") == entity).orderBy("ord").limit(SESSION_FACTS).select(F.col("ord").cast("long").alias("ord"), "id", "statement")
    return first.crossJoin(F.broadcast(live.agg(F.count("*").alias("active_facts"))))  # one row
