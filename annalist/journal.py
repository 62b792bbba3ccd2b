"""The event log: append-only Parquet partitioned by day, with ids that are never taken twice.

One writer appends at a time: it holds a lock file that only one can make. New events get consecutive numbers after the highest one; ids that are present are
skipped, those of redacted events included, so that erased text does not come back. A batch is
numbered from per-partition counts, not by one sort of all rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import text
from annalist.schemas import EVENT
from annalist.storage import cut, only_writer

ERASED = "[erased]"


def raw_events(rows: DataFrame, kind: str, scope: str = "personal", session: str = "default") -> DataFrame:
    """Adapter rows (source_id, position, occurred_at, role, content, metadata, and what orders them) as events."""
    src = F.col("source_id")
    position = F.col("position").cast("long")
    custom = F.lit(None).cast("string")
    return rows.select(
        text.event_id(F.lit(kind), src, position, custom).alias("event_id"),
        F.lit(scope).alias("scope_id"),
        F.lit(session).alias("session_id"),
        "occurred_at",
        "role",
        F.struct(F.lit(kind).alias("kind"), custom.alias("custom_kind"), src.alias("source_id"), position.alias("position"), F.col("occurred_at")).alias("source"),
        "content",
        F.sha2("content", 256).alias("content_sha256"),
        F.lit("none").alias("redaction"),
        "metadata",
        "file",
        "line",
    )


def fresh(events: DataFrame, present: DataFrame, order: list[str]) -> DataFrame:
    """The first event, in ``order``, of each id that is not present yet."""
    columns = events.columns
    first = events.withColumn("_order", F.struct(*order)).groupBy("event_id").agg(F.min_by(F.struct(*columns), "_order").alias("e")).select("e.*")
    return first.join(present.select("event_id"), "event_id", "left_anti").select(*columns)


def first_kept(rows: DataFrame, order: list[str], id_key: str, other_key: str) -> DataFrame:
    """The rows that a pass in ``order`` keeps if a row falls that shares either key with a row kept before.

    A row that falls takes no other with it, so one pass for each key would drop too many. Rounds
    decide many rows at once: of those left, a row that is the first under both its keys is kept, and
    all that share a key with it fall. A null key is shared with none; of rows that ``order`` does not
    tell apart any may come first. Rows with both keys alike are one case and are joined to their first
    before the rounds. Keys that come from the same source take a round or two; a chain of rows, each
    sharing a key with the next, takes half as many rounds as it has rows.
    """
    columns, keys = rows.columns, (id_key, other_key)
    named = rows.select(F.struct(*columns).alias("_r"), F.struct(*order, F.monotonically_increasing_id()).alias("_o"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(keys)))
    named = cut(named)
    free = named.filter("_0 is null and _1 is null").select("_r.*")
    left = named.filter("_0 is not null or _1 is not null").groupBy("_0", "_1").agg(F.min_by("_r", "_o").alias("_r"), F.min("_o").alias("_o"))
    left, out = cut(left), free
    while not left.isEmpty():
        marked = left
        for key in ("_0", "_1"):
            first = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("_o").alias(f"{key}_first"))
            marked = marked.join(first, key, "left")
        kept = cut(marked.filter(" and ".join(f"({k} is null or {k}_first <=> _o)" for k in ("_0", "_1"))).select(left.columns))
        out = out.unionByName(kept.select("_r.*"))
        for key in ("_0", "_1"):
            left = left.join(kept.filter(F.col(key).isNotNull()).select(key), key, "left_anti")
        # A kept row has a key at least, under which it falls itself.
        left = cut(left.select("_0", "_1", "_r", "_o"))
    return out


def numbered(events: DataFrame, after: int, order: list[str]) -> DataFrame:
    """``events`` with consecutive ``seq`` after ``after``, in ``order``.

    Rows are dealt by ranges of the order, numbered within each range, and moved up by the counts of
    the ranges before it: no range is sorted by more than one task, and no task sorts all rows.
    """
    spread = cut(events.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*order)
    ranked = spread.withColumn("_k", F.row_number().over(within)).join(F.broadcast(offsets), "_part")
    return ranked.withColumn("seq", F.lit(after) + F.col("_offset") + F.col("_k")).drop("_part", "_k", "_offset")


def appended(journal: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """The events of ``batch`` that the journal lacks, numbered after its highest seq."""
    last = journal.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return numbered(fresh(batch, journal, order), last, order)


def redacted(events: DataFrame, ids: DataFrame) -> DataFrame:
    """``events`` with the text of those in ``ids`` (event_id) erased: content, hash, metadata but for the project."""
    hit = F.col("_hit").isNotNull()
    project = F.get_json_object("metadata", "$.project")
    kept = F.when(project.isNotNull(), F.to_json(F.struct(project.alias("project")))).otherwise(F.lit("{}"))
    marked = events.join(ids.select("event_id", F.lit(True).alias("_hit")).distinct(), "event_id", "left")
    return marked.select(
        *(
            F.when(hit, {"content": F.lit(ERASED), "content_sha256": F.sha2(F.lit(ERASED), 256), "redaction": F.lit("full"), "metadata": kept}[c]).otherwise(F.col(c)).alias(c)
            if c in ("content", "content_sha256", "redaction", "metadata")
            else F.col(c)
            for c in events.columns
        )
    )


def framed(files: DataFrame) -> DataFrame:
    """(file, k, body) of framed logs (file, content): a header line with a byte count, then that record.

    A record whose bytes do not fit its header ends its file: it and what follows were torn off.
    """
    lines = files.select("file", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    header = F.try_to_number(F.regexp_extract("line", r"^([0-9]{1,9})$", 1), F.lit("999999999")).cast("long")
    odd = F.col("at") % 2
    pairs = lines.withColumn("k", F.floor(F.col("at") / 2)).groupBy("file", "k").agg(
        F.max(F.when(odd == 0, header)).alias("size"), F.max(F.when(odd == 1, F.col("line"))).alias("body"), F.count("*").alias("n")
    )
    whole = pairs.filter("n = 2 or size is not null")
    good = F.coalesce(F.octet_length("body") == F.col("size"), F.lit(False))
    torn = whole.groupBy("file").agg(F.min(F.when(~good, F.col("k"))).alias("torn"))
    return whole.join(torn, "file").filter("torn is null or k < torn").select("file", "k", "body")


def frame(body: Column) -> Column:
    """A record with its header line."""
    return F.concat(F.octet_length(body).cast("string"), F.lit("\n"), body, F.lit("\n"))


def from_number(events: DataFrame, seq: int) -> DataFrame:
    """Events from a number on."""
    return events.filter(F.col("seq") >= seq)


def one_event(events: DataFrame, event_id: str, seq: int) -> DataFrame:
    """The event of an id and a number."""
    return events.filter((F.col("event_id") == event_id) & (F.col("seq") == seq)).limit(1)


def by_day(events: DataFrame, day: Column, seq: Column) -> DataFrame:
    """(day, n, first, last): events of each day and the range of their numbers."""
    return events.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.min(seq).alias("first"), F.max(seq).alias("last"))


class Journal:
    """The log in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def events(self, from_seq: int = 0) -> DataFrame:
        """All events from a seq on; Parquet statistics prune the files before it."""
        try:
            found = self.spark.read.schema(f"{EVENT}, project string, day date").parquet(self.path)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            found = self.spark.createDataFrame([], f"{EVENT}, project string, day date")
        return from_number(found, from_seq) if from_seq else found

    def lookup(self, event_id: str, seq: int) -> DataFrame:
        return one_event(self.events(), event_id, seq)

    def append(self, batch: DataFrame, order: list[str], now: Column | None = None) -> dict[str, int]:
        """Add the new events of a batch; how many were new and how many were skipped. One writer at a time."""
        with only_writer(self.spark, f"{self.path}.lock"):
            return self._append(batch, order, now)

    def append_one(self, kind: str, source_id: str, role: str, content: str, occurred_at: datetime | None = None, metadata: str = "{}", scope: str = "personal", session: str = "default") -> int:
        """Add one event; its number, also if it was there already."""
        row = (source_id, 0, occurred_at, role, content, metadata, "", 0)
        rows = self.spark.createDataFrame([row], "source_id string, position long, occurred_at timestamp, role string, content string, metadata string, file string, line long")
        event = cut(raw_events(rows, kind, scope, session))
        self.append(event, ["event_id"])
        return self.events().join(event.select("event_id"), "event_id", "left_semi").agg(F.min("seq")).first()[0]

    def days(self) -> DataFrame:
        """(day, n, first, last): the events of each day and the range of their numbers."""
        return by_day(self.events(), F.col("day"), F.col("seq"))

    def _append(self, batch: DataFrame, order: list[str], now: Column | None) -> dict[str, int]:
        now = F.current_timestamp() if now is None else now
        project = F.col("project") if "project" in batch.columns else F.get_json_object("metadata", "$.project")
        new = appended(self.events(), batch, order).withColumn("ingested_at", now).withColumn("project", project).withColumn("day", F.to_date("ingested_at"))
        names = [f.name for f in self.events().schema.fields]
        new = cut(new.withColumn("occurred_at", F.coalesce("occurred_at", "ingested_at")).select(names))
        count, total = new.count(), batch.count()
        if count:
            new.repartition("day").sortWithinPartitions("seq").write.mode("append").partitionBy("day").parquet(self.path)
        return {"new": count, "skipped": total - count}

    def redact(self, ids: DataFrame) -> int:
        """Erase the text of events; only the days that hold any are rewritten. How many had not been erased yet."""
        with only_writer(self.spark, f"{self.path}.lock"):
            return self._redact(ids)

    def _redact(self, ids: DataFrame) -> int:
        hit = self.events().join(ids.select("event_id").distinct(), "event_id", "left_semi").filter(F.col("redaction") != "full")
        days = [r.day for r in hit.select("day").distinct().collect()]
        count = hit.count()
        if days:
            touched = cut(redacted(self.events().filter(F.col("day").isin(days)), ids))
            touched.repartition("day").sortWithinPartitions("seq").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)
        return count
