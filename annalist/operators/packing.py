"""Rows in packs of bounded size, first come first packed, in one order over all rows but in many tasks.

A pack is closed before it would pass its bound; a row beyond that is a pack of its own. Where packs
start depends on all rows before, but of those only on how full the open pack is. So rows are dealt
by ranges of the order, and each range says for each fill with which it may be entered with which it
is left: a map of bounded size. Maps of neighbours are composed by doubling; the fill with which a
range is entered then gives its starts, and starts are numbered by counts of the ranges before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.storage import cut


def closings(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums up to each row, the row that closes a pack that starts at each row)."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return upto, np.maximum(np.searchsorted(upto[1:], upto[:-1] + most, "right"), np.arange(1, len(sizes) + 1))


def fills(sizes: np.ndarray, most: int) -> np.ndarray:
    """The fill of the open pack after these rows, by its fill before them: 0 to ``most``, and ``most`` + 1 for any beyond."""
    upto, close = closings(sizes, most)
    n = len(sizes)
    last = np.minimum(upto[n] - upto, most + 1)
    for k in range(n - 1, -1, -1):
        if close[k] < n:
            last[k] = last[close[k]]
    before = np.arange(most + 2)
    first = np.searchsorted(upto[1:], most - before, "right")
    return np.where(first < n, last[first], np.minimum(before + upto[n], most + 1)).astype(np.int32)


def starts(sizes: np.ndarray, most: int, fill: int) -> np.ndarray:
    """Which of these rows start a pack, if the open one has ``fill`` before them."""
    upto, close = closings(sizes, most)
    out = np.zeros(len(sizes), bool)
    k = int(np.searchsorted(upto[1:], most - fill, "right"))
    while k < len(sizes):
        out[k] = True
        k = int(close[k])
    return out


def packs(rows: DataFrame, order: list[str], size: Column, most: int) -> DataFrame:
    """``rows`` with ``pack``, counted from 0 in ``order``, which tells all rows apart and has no nulls.

    A null size counts as 0; an empty table gives an empty result.
    """
    spread = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    narrow = spread.select("_part", *order, F.coalesce(size, F.lit(0)).cast("long").alias("_size"))

    def mapped(key, table):
        sizes = table.sort_by([(c, "ascending") for c in order])["_size"].to_numpy()
        return pa.table({"_part": pa.array([key[0].as_py()], pa.int32()), "fills": pa.array([fills(sizes, most).tobytes()], pa.binary())})

    # Ranges may be empty: those that are not are numbered without gaps, a row for each range.
    place = Window.orderBy("_part")
    maps = cut(narrow.groupBy("_part").applyInArrow(mapped, "_part int, fills binary"))
    parts = maps.select("_part", F.row_number().over(place).alias("k"))
    known = cut(maps.join(parts, "_part").select("k", "fills"))
    count = known.count()

    def composed(stream):
        for batch in stream:
            k, late, early = (batch.column(i).to_pylist() for i in range(3))
            both = [a if b is None else np.frombuffer(a, np.int32)[np.frombuffer(b, np.int32)].tobytes() for a, b in zip(late, early, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(both, pa.binary())], ["k", "fills"])

    step = 1
    while step < count:
        early = known.select((F.col("k") + step).alias("k"), F.col("fills").alias("early"))
        known = cut(known.join(early, "k", "left").select("k", "fills", "early").mapInArrow(composed, "k int, fills binary"))
        step *= 2

    def left(stream):
        for batch in stream:
            # No pack is open before the first row, as if one were closed.
            fill = [int(np.frombuffer(x, np.int32)[most + 1]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fill, pa.int32())], ["k", "fill"])

    entered = known.mapInArrow(left, "k int, fill int").select((F.col("k") + 1).alias("k"), "fill")
    entered = parts.join(entered, "k", "left").select("_part", F.coalesce("fill", F.lit(most + 1)).alias("fill"))
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in order)

    def started(table):
        table = table.sort_by([(c, "ascending") for c in order])
        begin = starts(table["_size"].to_numpy(), most, table["fill"][0].as_py())
        return table.select(["_part", *order]).append_column("_nth", pa.array(np.cumsum(begin), pa.int64()))

    placed = cut(narrow.join(entered, "_part").groupBy("_part").applyInArrow(started, f"_part int, {keys}, _nth long"))
    counts = placed.groupBy("_part").agg(F.max("_nth").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbers = placed.join(offsets, "_part").select(*order, (F.col("_before") + F.col("_nth") - 1).alias("pack"))
    return spread.drop("_part").join(numbers, order)
