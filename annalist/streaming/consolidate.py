"""Consolidation: the event log is read in bounded batches, each published once.

A batch is the next ``high_water`` events after the checkpoint, whatever their scope; a scope filter
applies within it, so that the checkpoint always advances. Late events simply have later numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(events: DataFrame, after: int, high_water: int) -> DataFrame:
    """(batch, from_seq, through_seq, events) of all batches after a checkpoint.

    Events are numbered by ranges of ``seq``, not by one sort of all of them.
    """
    from annalist.journal import numbered

    rows = numbered(events.filter(F.col("seq") > after).select(F.col("seq").alias("at")), 0, ["at"])
    batch = F.floor((F.col("seq") - 1) / high_water)
    return rows.groupBy(batch.alias("batch")).agg(F.min("at").alias("from_seq"), F.max("at").alias("through_seq"), F.count("*").alias("events"))


def next_window(events: DataFrame, after: int, high_water: int) -> int | None:
    """The number of the last event of the next batch; None if there is none. A top-k, not a sort."""
    rows = events.filter(F.col("seq") > after).orderBy("seq").limit(max(high_water, 1)).agg(F.max("seq")).first()
    return rows[0]




def follow(events: DataFrame, publish, checkpoint: str):
    """Run ``publish(batch, batch_id)`` over a stream of new journal files until it has caught up.

    Structured Streaming keeps the offsets in ``checkpoint``; a batch that is replayed after a
    failure has the same id, so a publisher that names its request by it applies it once.
    """
    query = events.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
