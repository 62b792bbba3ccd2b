"""Changes to facts and controls: remember, correct, forget, retire, erase. DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.storage import cut

ENTITY_BYTES, FACT_BYTES, SPILLS = 56_000, 600, 50


def upserted(facts: DataFrame, new: DataFrame) -> DataFrame:
    """``facts`` with those of ``new`` added; a fact of the same id is replaced whole, even a superseded one."""
    rest = facts.join(new.select("id"), "id", "left_anti").select(facts.columns)
    return rest.unionByName(new.select(facts.columns))


def superseded(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``facts`` after corrections (id, new_id): the old fact is superseded and names the new one."""
    p = pairs.select(F.col("id").alias("_old"), "new_id")
    both = facts.join(p, F.col("id") == F.col("_old"), "left")
    hit = F.col("new_id").isNotNull()
    out = both.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status")))
    named = F.when(hit, F.array_append(F.coalesce("supersedes", F.array().cast("array<string>")), F.col("new_id"))).otherwise(F.col("supersedes"))
    return out.withColumn("supersedes", named).select(facts.columns)


def with_status(facts: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """``facts`` with the status of those in ``ids`` (id) set."""
    hit = facts.join(ids.select(F.col("id").alias("_hit")).distinct(), F.col("id") == F.col("_hit"), "left")
    return hit.withColumn("status", F.when(F.col("_hit").isNotNull(), status).otherwise(F.col("status"))).select(facts.columns)


def forgotten(controls: DataFrame, ids: DataFrame, reason: str = "") -> DataFrame:
    """``controls`` with each id suppressed and retracted."""
    both = F.explode(F.array(F.lit("suppressed"), F.lit("retracted"))).alias("control")
    new = ids.select(both, F.col("id").alias("target"))
    rest = new.join(controls.select("control", "target"), ["control", "target"], "left_anti")
    fill = {"at": F.current_timestamp(), "reason": F.lit(reason), "state": F.lit(None).cast("string")}
    return controls.unionByName(rest.select("control", "target", *(fill[c].alias(c) for c in controls.columns if c in fill)))


def prunable(controls: DataFrame) -> DataFrame:
    """Ids that are both suppressed and retracted."""
    kinds = controls.filter("control in ('suppressed', 'retracted')").groupBy("target").agg(F.count_distinct("control").alias("n"))
    return kinds.filter("n = 2").select(F.col("target").alias("id"))


def pruned(facts: DataFrame, controls: DataFrame) -> DataFrame:
    """``facts`` without those that were forgotten."""
    return facts.join(prunable(controls), "id", "left_anti").select(facts.columns)


def homes(entities: list[tuple[str, int]], base: str, sizes: list[int]) -> list[str | None]:
    """The file of each new fact: the first of the family with room, else the next spill file; null when fifty are full.

    ``entities`` are the family's files with their bytes, ``sizes`` the statements' bytes, in order.
    """
    held, out = dict(entities), []
    names = [base, *(f"{base}_{k}" for k in range(2, SPILLS + 1))]
    for size in sizes:
        home = next((n for n in names if held.get(n, 0) + size + FACT_BYTES <= ENTITY_BYTES), None)
        if home is not None:
            held[home] = held.get(home, 0) + size + FACT_BYTES
        out.append(home)
    return out


def placed(proposals: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, home): the file for each new fact (id, entity_id, statement, order), family by family.

    ``sizes`` has (entity_id, family, bytes) of the present files. A family holds at most fifty files
    of bounded size; a fact that fits nowhere is skipped, and later ones go on. Each round places the
    next facts of every family, as many as its files could hold at most, and leaves out those of the
    rest that are too large for all files: room never grows. It ends when no fact is left.
    """
    from pyspark.sql import Window

    most = SPILLS * (ENTITY_BYTES // FACT_BYTES)
    files = sizes.groupBy("family").agg(F.collect_list(F.struct("entity_id", F.col("bytes").cast("long").alias("bytes"))).alias("files"))
    size = F.coalesce(F.octet_length("statement"), F.lit(0))
    waiting = cut(proposals.select("entity_id", "order", "id", size.alias("n")).filter(F.col("n") + FACT_BYTES <= ENTITY_BYTES))

    def fill(entity_id, new, files):
        held = {f["entity_id"]: f["bytes"] for f in files or []}
        found = homes(list(held.items()), entity_id, [x["n"] for x in new])
        for x, h in zip(new, found, strict=True):
            if h is not None:
                held[h] = held.get(h, 0) + x["n"] + FACT_BYTES
        names = [entity_id, *(f"{entity_id}_{k}" for k in range(2, SPILLS + 1))]
        return {
            "placed": [{"id": x["id"], "home": h} for x, h in zip(new, found, strict=True) if h is not None],
            "files": [{"entity_id": k, "bytes": v} for k, v in held.items()],
            "room": max(ENTITY_BYTES - held.get(k, 0) for k in names),
        }

    fold = F.udf(fill, "struct<placed:array<struct<id:string, home:string>>, files:array<struct<entity_id:string, bytes:bigint>>, room:bigint>")
    place, out = F.struct("order", "id"), None
    while True:
        # Equal places are taken together, so that none is cut in two.
        near = waiting.withColumn("k", F.rank().over(Window.partitionBy("entity_id").orderBy("order", "id"))).filter(F.col("k") <= most)
        new = near.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("order", "id", "n"))).alias("new"), F.max(place).alias("last"))
        rows = new.join(files, F.col("entity_id") == F.col("family"), "left")
        step = cut(rows.select("entity_id", "last", fold("entity_id", "new", "files").alias("f")))
        found = step.select(F.explode("f.placed").alias("p")).select("p.id", "p.home")
        out = found if out is None else out.unionByName(found)
        ends = step.select("entity_id", "last", F.col("f.room").alias("room"))
        waiting = cut(waiting.join(ends, "entity_id").filter((place > F.col("last")) & (F.col("n") + FACT_BYTES <= F.col("room"))).select(waiting.columns))
        if waiting.isEmpty():
            return out
        files = step.select(F.col("entity_id").alias("family"), F.col("f.files").alias("files"))


def erasure_targets(facts: DataFrame, target: str) -> DataFrame:
    """The facts that an erasure of a fact id or an entity id (spill files included) removes."""
    from annalist.functions import text

    return facts.filter((F.col("id") == target) | (F.col("entity_id") == target) | (text.family(F.col("entity_id")) == target))


def source_events(facts: DataFrame) -> DataFrame:
    """(event_id): the events that facts were learned from."""
    return facts.select(F.explode("source_ids").alias("event_id")).distinct()


def scrubbed(lines: DataFrame, needles: DataFrame, column: str) -> DataFrame:
    """Lines that hold none of a few needles (needle); a needle counts as a whole word, so one id does not match a longer one.

    ``needles`` are the ids and statements of one erasure: a handful.
    """
    found = needles.agg(F.collect_set("needle").alias("needles"))

    def named(needle: Column) -> Column:
        word = F.concat(F.lit(r"(^|[^A-Za-z0-9_])\Q"), needle, F.lit(r"\E($|[^A-Za-z0-9_])"))
        # Few lines hold a needle at all: its pattern, which is compiled anew for each row, is asked for these only.
        return F.coalesce(F.contains(F.col(column), needle) & F.rlike(F.col(column), word), F.lit(False))

    return lines.crossJoin(F.broadcast(found)).filter(~F.exists("needles", named)).drop("needles")


def agreed(first: DataFrame, second: DataFrame, keep: DataFrame) -> DataFrame:
    """(id): what two passes of a judge both name, each once, but for what is to be kept."""
    return first.select("id").intersect(second.select("id")).join(keep.select("id"), "id", "left_anti")
