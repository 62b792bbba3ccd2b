"""What must hold of a store: references are known, targets exist, changes are well-formed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import text
from annalist.operators import eligibility

FILES, PAYLOAD_BYTES, FILE_BYTES = 64, 256 * 1024, 64 * 1024


def unknown_references(texts: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """(reference) cited in texts that no fact has."""
    cited = texts.select(F.explode(text.reference_tokens(F.col(column))).alias("reference")).distinct()
    return cited.join(facts.select(F.col("id").alias("reference")), "reference", "left_anti")


def unknown_targets(controls: DataFrame, facts: DataFrame) -> DataFrame:
    """(target) of suppressions that name no fact or entity, but for those deleted or retracted since."""
    wanted = controls.filter("control = 'suppressed'").select("target").distinct()
    known = facts.select(F.explode(F.array("id", "entity_id")).alias("target")).unionByName(controls.filter("control in ('deleted', 'retracted')").select("target"))
    return wanted.join(known, "target", "left_anti")


def bad_changes(changes: DataFrame) -> DataFrame:
    """(path, reason) of a change set (path, content; null content deletes) that may not be published."""
    json = F.endswith("path", F.lit(".json")) & F.col("content").isNotNull()
    reasons = F.array_compact(
        F.array(
            F.when(~eligibility.writable(F.col("path")), "path"),
            F.when(F.octet_length("content") > FILE_BYTES, "size"),
            F.when(json & F.try_parse_json("content").isNull(), "json"),
            F.when(F.col("n") > 1, "twice"),
        )
    )
    counted = changes.groupBy("path").agg(F.count("*").alias("n"), F.max("content").alias("content"))
    each = counted.select("path", F.explode(reasons).alias("reason"))
    whole = changes.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
    limits = F.array_compact(F.array(F.when(~F.col("files").between(1, FILES), "files"), F.when(F.col("bytes") > PAYLOAD_BYTES, "payload")))
    return each.unionByName(whole.select(F.lit(None).cast("string").alias("path"), F.explode(limits).alias("reason")))
