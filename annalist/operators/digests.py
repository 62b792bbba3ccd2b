"""Digests of texts that fit no row and no task: the pieces of a group, in order, one part after another."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import md5
from annalist.storage import cut, shared_dir

#: Bytes of a group that one task digests, and of a range, which tasks do not divide.
TURN_BYTES, RANGE_BYTES = 64 << 20, 16 << 20
#: What a row takes beside its piece, roughly.
ROW_BYTES = 64

_STATE = "_last int, _state binary, _n long, _pieces long, _md5 string"


def _turn(gap: bytes):
    """Rows (_by, _last, _state, _n, _pieces, _piece), those of a group one after another, a state first if there is one, as each group's next state."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = last = state = None
        n = pieces = 0
        held: list[bytes] = []

        def digest() -> None:
            nonlocal state
            if held:
                state = md5.updated(state, b"".join(held))
                held.clear()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["_by", *(f.split()[0] for f in _STATE.split(", "))])

        def row() -> tuple:
            digest()
            return by, last, state, n, pieces, md5.hexdigest(state) if pieces else None

        for batch in stream:
            kind, closed = batch.schema.field(0).type, []
            for its, its_last, before, its_n, its_pieces, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or its != by:
                    if state is not None:
                        closed.append(row())
                    by, last, state, n, pieces = its, its_last, md5.start(), 0, 0
                if before is not None:
                    state, n, pieces = before, its_n, its_pieces
                    continue
                n += 1
                if piece is not None:
                    held += [gap, piece] if pieces else [piece]
                    pieces += 1
            digest()
            if closed:
                yield out(closed)
        if state is not None:
            yield out([row()])

    return run


def ordered_md5(rows: DataFrame, by: str, order: list[str], piece: str, gap: str = "") -> DataFrame:
    """(``by``, n, md5): of each group its rows and the MD5 of its pieces in ``order``, joined by ``gap``; groups may be of any size.

    Null pieces are left out; a group of such pieces only has no digest. Rows that ``order`` does not
    tell apart go by their pieces. Rows are dealt by ranges of the order, whose number grows with the
    bytes. MD5 runs over bytes in order, so a group's ranges take turns: each turn digests some
    ``TURN_BYTES`` of every group that has as many left, from the state in which the turn before left
    it. No task reads a group, but turns follow one another: there are as many as the largest group needs.
    """
    spark, keys = rows.sparkSession, [f"_o{k}" for k in range(len(order))]
    rows = rows.select(F.col(by).alias("_by"), *(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)), F.col(piece).alias("_piece"))
    rows = rows.withColumn("_size", F.coalesce(F.octet_length("_piece"), F.lit(0)) + ROW_BYTES)
    ranges = 1 + (rows.agg(F.sum("_size")).first()[0] or 0) // RANGE_BYTES
    dealt = rows.repartitionByRange(ranges, "_by", *keys, F.left("_piece", F.lit(64))).withColumn("_part", F.spark_partition_id())
    folder = f"{shared_dir(spark).rstrip('/')}/digests-{uuid.uuid4().hex}"
    dealt.write.partitionBy("_part").parquet(f"{folder}/parts")
    dealt = spark.read.schema(dealt.schema).parquet(f"{folder}/parts")
    # A row for each group and range, of which there are no more than groups and ranges together.
    sizes = dealt.groupBy("_by", "_part").agg(F.sum("_size").alias("_size"))
    own = Window.partitionBy("_by")
    before = F.coalesce(F.sum("_size").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = sizes.withColumn("_full", F.floor(before / TURN_BYTES)).withColumn("_turn", F.dense_rank().over(own.orderBy("_full")) - 1)
    # A group goes to the task of its turn's first range, so that a task gets the groups of a range, of which only the last goes on.
    first = F.min("_part").over(Window.partitionBy("_by", "_turn"))
    turns = cut(turns.select(F.col("_by").alias("_whose"), F.col("_part").alias("_at"), "_turn", F.max("_turn").over(own).alias("_last"), first.alias("_first")))
    kind = f"_by {rows.schema['_by'].dataType.simpleString()}, {_STATE}"
    columns = ["_by", "_last", "_state", "_n", "_pieces", "_piece"]
    nothing = {"_state": "binary", "_n": "long", "_pieces": "long"}
    states = None
    for turn, parts in turns.groupBy("_turn").agg(F.sort_array(F.collect_set("_at"))).orderBy("_turn").collect():
        task = F.array_position(F.array(*map(F.lit, parts)), F.col("_first")).cast("int") - 1
        its = turns.filter(F.col("_turn") == turn).select("_whose", "_at", "_last", task.alias("_task"))
        lines = dealt.filter(F.col("_part").isin(parts)).join(its, F.col("_by").eqNullSafe(F.col("_whose")) & (F.col("_part") == F.col("_at")))
        lines = lines.select("*", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items())).withColumn("_piece", F.col("_piece").cast("binary"))
        if states is not None:
            left = states.filter(F.col("_last") >= turn).join(its.select("_whose", "_task").distinct(), F.col("_by").eqNullSafe(F.col("_whose"))).drop("_whose")
            lines = left.unionByName(lines.select("_by", *keys, "_piece", "_last", "_task", *nothing), allowMissingColumns=True)
        lines = lines.repartitionById(len(parts), F.col("_task")).sortWithinPartitions("_by", F.col("_state").isNull(), *keys, "_piece").select(columns)
        path = f"{folder}/states/_turn={turn}"
        lines.mapInArrow(_turn(gap.encode()), kind).write.parquet(path)
        states = spark.read.schema(kind).parquet(path)
    if states is None:
        return spark.createDataFrame([], f"{kind}, _turn int").select(F.col("_by").alias(by), F.col("_n").alias("n"), F.col("_md5").alias("md5"))
    found = spark.read.schema(f"{kind}, _turn int").parquet(f"{folder}/states").filter("_turn = _last")
    return found.select(F.col("_by").alias(by), F.col("_n").alias("n"), F.col("_md5").alias("md5"))
