"""Sharding by balanced label propagation: equal texts move together while shard sizes stay equal.

Documents are dealt by hash. In each round every split group of linked documents (equal texts) votes
for the shard that most of it is in, among those with room for it, or else for any shard with room,
drawn by spare capacity; a quota, the share of the demand that the shard's capacity admits, decides
which groups move, and a join carries the decisions to the documents. The last few thousand groups
are placed exactly, and rounds end when no group is split or none that is fits anywhere. Groups larger than half a shard,
of which there are at most twice as many as shards, are planned on the driver over as few shards as
hold them. Documents without links are ballast:
passes over a histogram of (shard, hash bucket) move whole buckets from shards that are too large
to those that are too small, finer in each pass, down to single documents.

Law ``bytes``: sizes differ from their mean by about one document at most, unless single texts are
larger than a shard. Slots number each shard's rows without gaps.

Defined cases: a null text has size 16 and the crc32 of an empty one, and is linked with empty
texts; repeated rows are each placed; null ids are placed like others; texts of any length count
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.common import cut, table

SHARDS = 40
OVERHEAD = 16
#: Groups that are placed exactly, on the driver, at a time.
PLACED = 1 << 12
PASSES = 4
BUCKETS = 1024
#: In each later pass only so large a part of the ballast is put into buckets.
FINER = 8 / BUCKETS
SLOTS_AT_ONCE = 1 << 14
_SPAN = 1 << 40


def _draw(salt: int, *columns: str) -> Column:
    """An even draw from 0 to 1 that depends on the columns and the salt."""
    return F.pmod(F.xxhash64(*columns, F.lit(salt)), F.lit(_SPAN)) / F.lit(float(_SPAN))


def sized(docs: DataFrame) -> DataFrame:
    """(row, doc_id, size, text_crc32, k1, k2): sizes, and text keys of 128 bits by two seeds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("second"), text).alias("k2"),
    )


def named(rows: DataFrame) -> DataFrame:
    """``rows`` of ``sized`` with ``name``, by which draws are made: it follows from id and text, so that the layout of files decides nothing.

    Rows of equal id and text, between which nothing can tell, are told apart by their places.
    """
    key = ["doc_id", "k1", "k2"]
    again = rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*(F.col(c).alias(f"r_{c}") for c in key), F.col("n"))
    same = F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("k1") == F.col("r_k1")) & (F.col("k2") == F.col("r_k2"))
    both = rows.join(again.hint("merge"), same, "left")
    return both.select(*rows.columns, F.xxhash64(*key, F.when(F.col("n").isNotNull(), F.col("row"))).alias("name"))


def _loads(df: DataFrame, shards: int) -> list[float]:
    out = [0.0] * shards
    for shard, size in df.groupBy("shard").agg(F.sum("size")).collect():  # a row for each shard
        out[shard] = float(size)
    return out


def plan_large(groups: list[tuple[tuple[int, int], float, dict[int, int]]], capacity: float, room: list[float]) -> dict[tuple[int, int], list[tuple[int, float]]]:
    """Shards and upper bounds of draws for groups larger than half a shard; ``room`` is used up.

    A group takes the shards that hold most of it, each as far as it has room, and what is over is
    spread evenly.
    """
    out = {}
    for key, size, held in sorted(groups, key=lambda g: (-g[1], g[0])):
        left, parts = size, []
        for shard in sorted(range(len(room)), key=lambda k: (room[k] < capacity / 2, -held.get(k, 0), k)):
            # Rows are drawn: three standard deviations are left free, so that no shard ends too full.
            free = max(room[shard], 0.0)
            taken = min(left, free - min(3 * (free * size / max(sum(held.values()), 1)) ** 0.5, free / 5))
            if taken > 0:
                parts.append((shard, taken))
                room[shard] -= taken
                left -= taken
        if left > 0:
            parts = [(k, dict(parts).get(k, 0.0) + left / len(room)) for k in range(len(room))]
        total, upto, bounds = sum(x for _, x in parts), 0.0, []
        for shard, taken in parts:
            upto += taken
            bounds.append((shard, min(1.0, upto / total)))
        out[key] = [*bounds[:-1], (bounds[-1][0], 1.0)]
    return out


def place_exactly(groups: list[tuple[tuple[int, int], float, list[int]]], spare: list[float]) -> dict[tuple[int, int], int]:
    """A shard for each group (key, size, its shards, most of it first) that fits, largest first; ``spare`` is used up."""
    out = {}
    for key, size, held in sorted(groups, key=lambda g: (-g[1], g[0])):
        widest = max(range(len(spare)), key=lambda k: (spare[k], -k))
        to = next((k for k in [*held, widest] if spare[k] >= size), None)
        if to is not None:
            spare[to] -= size
            out[key] = to
    return out


def propagate(linked: DataFrame, total: float, shards: int) -> DataFrame:
    """``linked`` (row, doc_id, size, text_crc32, k1, k2, name, shard) with the shards that its groups have moved to, and ``spread``: is the group planned over several?"""
    spark, capacity = linked.sparkSession, total / shards
    planned: dict[tuple[int, int], list[tuple[int, float]]] = {}
    state, turn, before = cut(linked.withColumn("spread", F.lit(False))), 0, -1
    while True:
        cells = cut(state.groupBy("k1", "k2", "shard").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
        groups = cells.groupBy("k1", "k2").agg(F.sum("size").alias("size"), F.count("*").alias("cells"), F.sort_array(F.collect_list(F.struct("n", F.col("shard"))), asc=False).alias("votes"))  # SHARDS cells at most
        groups = groups.withColumn("large", F.col("size") > capacity / 2)
        if turn == 0:
            # At most 2 * shards groups can each hold more than half a shard.
            large = [((g.k1, g.k2), float(g["size"]), {v.shard: v.n for v in g.votes}) for g in groups.filter("large").collect()]
            room = [capacity] * shards
            planned = plan_large(large, capacity, room)
        together = [0.0] * shards
        for shard, size in groups.filter("not large and cells = 1").groupBy(F.col("votes")[0]["shard"]).agg(F.sum("size")).collect():
            together[shard] = float(size)
        spare = [max(r - t, 0.0) for r, t in zip(room, together, strict=True)]
        split = groups.filter("not large and cells > 1")
        left = split.count()
        if turn and not left:
            break
        if left <= PLACED or left == before:
            # The smallest: if none of them fits, none of the others does.
            few = [((g.k1, g.k2), float(g["size"]), [v.shard for v in sorted(g.votes, key=lambda v: (-v.n, v.shard))]) for g in split.orderBy("size", "k1", "k2").limit(PLACED).collect()]
            found = place_exactly(few, spare)
            if turn and not found:
                break
            moves = spark.createDataFrame([(*key, [to], [1.0]) for key, to in found.items()], _MOVES)
        else:
            best = F.array_sort(F.filter("votes", lambda v: F.array(*(F.lit(x) for x in spare))[v["shard"]] >= F.col("size")), _first)
            # The least of exponential draws at the rates of the spare capacities.
            drawn = F.array_max(
                F.array(*(F.when(F.col("size") <= x, F.struct((F.log(_draw(4000 + turn * shards + k, "k1", "k2") + 1e-13) / max(x, 1.0)).alias("draw"), F.lit(k).alias("shard"))) for k, x in enumerate(spare)))
            )["shard"]
            votes = cut(split.select("k1", "k2", "size", F.coalesce(F.try_element_at(best, F.lit(1))["shard"], drawn).alias("target")).filter("target is not null"))
            quotas = [0.0] * shards
            for shard, size, squares in votes.groupBy("target").agg(F.sum("size"), F.sum(F.col("size").cast("double") * F.col("size"))).collect():
                # Three standard deviations below the room, so that draws do not overfill a shard.
                quotas[shard] = 1.0 if size <= spare[shard] else max(spare[shard] - 3 * squares**0.5, 0.0) / float(size)
            quota = F.array(*map(F.lit, quotas))
            moves = votes.filter(_draw(1000 + turn, "k1", "k2") < quota[F.col("target")]).select("k1", "k2", F.array(F.col("target")).alias("to"), F.array(F.lit(1.0)).alias("upto"))
        if turn == 0 and planned:
            rows = [(*key, [s for s, _ in parts], [x for _, x in parts]) for key, parts in planned.items()]
            moves = moves.unionByName(spark.createDataFrame(rows, _MOVES))
        moves = cut(moves)
        draw = _draw(2000, "name")
        chosen = F.element_at(F.col("to"), F.size(F.filter("upto", lambda x: x <= draw)).cast("int") + 1)
        state = cut(state.join(moves.hint("merge"), ["k1", "k2"], "left").withColumn("shard", F.coalesce(chosen, "shard")).withColumn("spread", F.coalesce(F.size("to") > 1, "spread")).select(state.columns))
        turn, before = turn + 1, left
    return state


_MOVES = "k1 long, k2 long, to array<int>, upto array<double>"


def _first(a: Column, b: Column) -> Column:
    """Most votes first, then the smaller shard."""
    return F.when(a["n"] != b["n"], F.when(a["n"] > b["n"], -1).otherwise(1)).otherwise(F.when(a["shard"] < b["shard"], -1).when(a["shard"] > b["shard"], 1).otherwise(0))


def even_out(state: DataFrame, movable: Column, total: float, shards: int, first: int, passes: int) -> DataFrame:
    """``state`` (row, size, shard and more) after moving buckets of movable rows towards the mean size."""
    spark, mean = state.sparkSession, total / shards
    for turn in range(passes):
        loads = _loads(state, shards)
        over = [max(x - mean, 0.0) for x in loads]
        under = [max(mean - x, 0.0) for x in loads]
        if max(over, default=0) < 1:
            break
        part = FINER**turn
        draw = _draw(first + turn, "name")
        bucket = F.when(movable & (draw < part), F.floor(draw / part * BUCKETS).cast("int"))
        full = F.array(*(F.lit(x > 0) for x in over))
        found = state.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull() & full[F.col("shard")])
        moves = []
        cells = found.groupBy("shard", "bucket").agg(F.sum("size").alias("size")).collect()  # shards * BUCKETS rows at most
        for shard, k, size in sorted(cells, key=lambda c: (-c[2], c[0], c[1])):
            # The shard whose need is largest; a move must bring both ends nearer to the mean.
            to = max(range(shards), key=lambda s: (under[s], -s))
            if size <= over[shard] and size <= under[to]:
                over[shard] -= size
                under[to] -= size
                moves.append((shard, k, to))
        if not moves:
            continue
        to = F.broadcast(spark.createDataFrame(moves, "shard int, bucket int, to int"))  # as bounded as the cells
        state = cut(state.withColumn("bucket", bucket).join(to, ["shard", "bucket"], "left").withColumn("shard", F.coalesce("to", "shard")).select(state.columns))
    return state


def with_slots(state: DataFrame) -> DataFrame:
    """``state`` with gapless ``slot`` numbers in each shard: parts of bounded size are numbered apart."""
    largest = state.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-largest // SLOTS_AT_ONCE) or 1
    state = state.withColumn("part", F.floor(_draw(3000, "name") * parts))
    sizes = state.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "k1", "k2", "row")
    return state.withColumn("k", F.row_number().over(within)).join(offsets, ["shard", "part"]).withColumn("slot", F.col("offset") + F.col("k") - 1)


def shards(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``."""
    base = cut(named(cut(sized(docs))).withColumn("shard", F.floor(_draw(0, "name") * count).cast("int")))
    total = float(base.agg(F.sum("size")).first()[0] or 0)
    many = cut(base.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2"))
    linked = base.join(many.hint("merge"), ["k1", "k2"], "left_semi").select(base.columns)
    single = base.join(many.hint("merge"), ["k1", "k2"], "left_anti").select(base.columns)
    state = propagate(linked, total, count).withColumn("alone", F.lit(False)).unionByName(single.withColumn("spread", F.lit(False)).withColumn("alone", F.lit(True)))
    state = even_out(cut(state), F.col("alone"), total, count, 100, PASSES)
    largest = state.agg(F.max("size")).first()[0] or 0
    # Too little ballast: copies that are spread anyway must give way, then all linked documents.
    for first, movable in ((300, F.col("alone") | F.col("spread")), (200, F.lit(True))):
        if max(abs(x - total / count) for x in _loads(state, count)) > max(largest, 0.01 * total / count):
            state = even_out(state, movable, total, count, first, PASSES)
    return with_slots(state).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of all documents."""
    return shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_sharding": query}
ORACLE_SQL: dict[str, str] = {}
