"""Shards of nearly equal bytes: minimax contiguous partition of ordered atomic groups.

Rows are put in the order (group, row id) by one range partitioning and numbered there; a group may
span partitions, so a hot group is no task of its own. The smallest feasible shard capacity is then
found by bisection with many capacities per step: one greedy step of all of them is one small
aggregation (for each capacity, the last group that ends within it), so the driver only holds
numbers per partition and per capacity, never groups or rows.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents, read_table, shuffle_partitions

#: Capacities tried at once in a step of the search.
WIDTH = 1024
#: Group ends that the driver lists; what lies between two of them is looked up on the executors.
SKIP = 16384


def minimax_shards(rows: DataFrame, n_shards: int, *, group: str = "group_key", row: str = "row_id", size: str = "size") -> DataFrame:
    """Adds shard (0..n_shards-1) and slot (gapless from 0 in each shard).

    Groups (equal values of `group`) are atomic and keep their order; the largest shard is as small
    as any contiguous partition allows. Null group values form one group, the first; null sizes
    count as 0; repeated rows are rows of their own; an empty table gives an empty table. Shards
    that no group is left for stay empty.
    """
    spark = rows.sparkSession
    parts = max(8, shuffle_partitions(spark))

    def small(**columns: list[int]) -> DataFrame:
        return spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()}))

    placed = cut(
        rows.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
        .repartitionByRange(parts, F.col(group), F.col(row))
        .sortWithinPartitions(group, row)
        .withColumns({"_part": F.spark_partition_id(), "_idx": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    )
    totals = {r["_part"]: (r["n"], r["b"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n"), F.sum("_size").alias("b")).collect()}
    first, before, n, b = {}, {}, 0, 0
    for p in sorted(totals):
        first[p], before[p] = n, b
        n, b = n + totals[p][0], b + totals[p][1]
    total = b
    offsets = small(_part=list(totals), _first=[first[p] for p in totals])
    order = Window.partitionBy("_part").orderBy("_idx")
    ends = cut(
        placed.select("_part", "_idx", F.col(group).alias("_group"), "_size", F.sum("_size").over(order).alias("_prefix"))
        .groupBy("_group")
        .agg(F.max(F.struct("_part", "_idx", "_prefix")).alias("last"), F.sum("_size").alias("gsize"))
        .select("_group", F.col("last._part").alias("_part"), F.col("last._prefix").alias("_local"), "gsize")
    )
    summary = ends.agg(F.max("gsize").alias("m"), F.count("*").alias("n")).first()
    largest, every = summary["m"] or 0, max(1, -(-summary["n"] // SKIP))
    nth = ends.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy("_local")))
    listed = nth.groupBy("_part", F.floor((F.col("_nth") - 1) / every)).agg(F.max("_local").alias("e")).collect()
    skip = sorted((before[r["_part"]] + r["e"], r["_part"]) for r in listed)  # at most SKIP ends and one more for each partition
    skip_ends = [e for e, _ in skip]

    def furthest(limits: list[int]) -> dict[int, int]:
        """For each limit, the greatest prefix of whole groups that is not above it."""
        found, ask = {}, []
        for t in sorted(set(limits)):
            k = bisect_right(skip_ends, t)
            found[t] = skip_ends[k - 1] if k else 0
            if every > 1 and k < len(skip):
                p = skip[k][1]
                ask.append((t, p, t - before[p]))
        if ask:
            wanted = small(_limit=[x[0] for x in ask], _part=[x[1] for x in ask], _most=[x[2] for x in ask])
            band = F.col("_part").between(ask[0][1], ask[-1][1])
            for r in ends.where(band).join(F.broadcast(wanted), "_part").where("_local <= _most").groupBy("_limit", "_part").agg(F.max("_local").alias("e")).collect():
                found[r["_limit"]] = max(found[r["_limit"]], before[r["_part"]] + r["e"])
        return found

    def bounded(capacity: int, up: bool) -> bool:
        """Whether the capacity can do if every cut falls on the listed end before (or, up, as late as the next one allows)."""
        at = 0
        for _ in range(n_shards):
            k = bisect_right(skip_ends, at + capacity)
            at = min(skip_ends[k] if k < len(skip) else total, at + capacity) if up and every > 1 else (skip_ends[k - 1] if k else 0)
            if at >= total:
                return True
        return False

    def lowest(low: int, high: int, up: bool) -> int:
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if bounded(mid, up) else (mid + 1, high)
        return low

    def greedy(capacities: list[int]) -> dict[int, list[int]]:
        """Cuts of each capacity, filling shards from the left."""
        cuts: dict[int, list[int]] = {c: [] for c in capacities}
        for _ in range(n_shards):
            at = {c: x[-1] if x else 0 for c, x in cuts.items()}
            reach = furthest([v + c for c, v in at.items() if v < total])
            for c, v in at.items():
                cuts[c].append(total if v >= total else reach[v + c])
        return cuts

    # No capacity below the mean or the largest group can do; their sum always can. The listed ends narrow that down.
    low, high = max(-(-total // n_shards), largest), max(-(-total // n_shards), largest) + largest
    low, high, best = lowest(low, high, True), lowest(low, high, False), None
    while best is None or low < high:
        tried = sorted({*range(low, high + 1, max(1, -(-(high - low + 1) // WIDTH))), high})
        made = greedy(tried)
        good = next(c for c in tried if made[c][-1] >= total)
        best, low, high = made[good], max([c + 1 for c in tried if c < good], default=good), good
    bounds = sorted({x for x in (best or []) if 0 < x < total})
    at = [(p, x - before[p]) for x in bounds for p in totals if 0 < x - before[p] <= totals[p][1]]
    keys = []
    if bounds:
        wanted = small(_part=[x[0] for x in at], _local=[x[1] for x in at])
        keys = [r["k"] for r in ends.join(F.broadcast(wanted), ["_part", "_local"]).groupBy("_part", "_local").agg(F.max("_group").alias("k")).orderBy("k").collect()]
    shard = F.lit(0)
    for k in keys:
        shard = shard + F.when(F.col(group) > F.lit(k), 1).otherwise(0) if k is not None else shard + F.when(F.col(group).isNotNull(), 1).otherwise(0)
    numbered = placed.join(F.broadcast(offsets), "_part").withColumns({"shard": shard.cast("int"), "_rank": F.col("_first") + F.col("_idx")})
    starts = {r["shard"]: r["s"] for r in numbered.groupBy("shard").agg(F.min("_rank").alias("s")).collect()}
    start = F.lit(0).cast("long")
    for s, r in sorted(starts.items()):
        start = F.when(F.col("shard") == s, F.lit(r)).otherwise(start)
    return numbered.withColumn("slot", F.col("_rank") - start).drop("_part", "_idx", "_size", "_first", "_rank")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by the law `bytes`; equal texts stay together (null text: one group, no bytes)."""
    rows = documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("")).otherwise(F.sha2("text", 256)).alias("group_key"),
    )
    return minimax_shards(rows, 24, row="doc_id").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
