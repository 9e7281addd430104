"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a tuple of k sums of bytes. Each group begins as one whose first sum is its bytes. The two
partial partitions of the largest spread are combined, the largest sum of one with the smallest of the other, until
one is left. Groups are dealt to buckets of bounded size, each of which is differenced by itself; the partial
partitions that the buckets leave are differenced in turn, level by level, so no task or driver holds all groups.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side

SHARDS = 16
#: Partial partitions that are combined in one task.
BUCKET = 20_000
#: Slots of partial partitions that are broadcast at most.
BROADCAST_SLOTS = 2_000_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, total): for each row of sums its k slots in the combined partition, and that partition's sums, largest first."""
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    top = np.take_along_axis(sums, order, axis=1)
    # members[i] lists, for each slot of a partial partition, the (row, column) that it holds, as a tree of pairs.
    tree: list[tuple] = [tuple((i, int(c)) for c in order[i]) for i in range(n)]
    heap = [(-(int(t[0]) - int(t[-1])), i) for i, t in enumerate(top)]
    heapq.heapify(heap)
    values = [tuple(int(x) for x in t) for t in top]
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = sorted(((values[a][j] + values[b][k - 1 - j], j) for j in range(k)), key=lambda x: (-x[0], x[1]))
        values.append(tuple(x[0] for x in joined))
        tree.append(("+", a, b, tuple(x[1] for x in joined)))
        heapq.heappush(heap, (-(joined[0][0] - joined[-1][0]), len(values) - 1))
    slot = np.zeros((n, k), np.int64)
    todo = [(len(values) - 1, tuple(range(k)))]
    while todo:
        node, names = todo.pop()
        if tree[node][0] == "+":
            _, a, b, perm = tree[node]
            to_a, to_b = [0] * k, [0] * k
            for at, j in enumerate(perm):
                to_a[j] = names[at]
                to_b[k - 1 - j] = names[at]
            todo += [(a, tuple(to_a)), (b, tuple(to_b))]
        else:
            for at, (i, c) in enumerate(tree[node]):
                slot[i, c] = names[at]
    return slot, np.array(values[-1], np.int64)


def buckets_of(n: int, bucket: int) -> int:
    """Buckets for n partial partitions."""
    return max(1, -(-n // bucket))


def _combine(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        slot, total = difference(np.array(pdf["sums"].tolist(), np.int64).reshape(len(pdf), k))
        top = [None] * len(pdf)
        top[0] = total.tolist()
        return pd.DataFrame({"up": pdf["up"], "item": pdf["item"], "slots": slot.tolist(), "total": top})

    return run


def partition_groups(groups: DataFrame, shards: int = SHARDS, bucket: int = BUCKET) -> DataFrame:
    """(g, shard) from (g string, bytes long), g distinct."""
    groups = cut(groups)
    count = groups.count()
    n = buckets_of(count, bucket)
    # The first level has one number for each group, not a tuple.
    name = lambda level, of, n: F.concat(F.lit(f"bucket {level} "), F.pmod(F.xxhash64(of), F.lit(n)).cast("string"))

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g", kind="stable")
        sums = np.zeros((len(pdf), shards), np.int64)
        sums[:, 0] = pdf["bytes"].to_numpy()
        slot, total = difference(sums)
        top = [None] * len(pdf)
        top[0] = total.tolist()
        return pd.DataFrame({"item": pdf["item"], "g": pdf["g"], "slot": slot[:, 0].astype(np.int32), "total": top})

    light = groups
    if n > 1:
        heavy = cut(groups.orderBy(F.desc("bytes"), "g").limit(bucket // 2))
        n = buckets_of(count - bucket // 2, bucket)
        light = groups.join(small_side(heavy.select("g")), "g", "left_anti")
    placed = light.withColumn("item", name(0, "g", n)).groupBy("item").applyInPandas(begin, "item string, g string, slot int, total array<long>")
    if count > bucket:
        alone = F.concat(F.array("bytes"), F.array_repeat(F.lit(0).cast("long"), shards - 1))
        placed = placed.unionByName(heavy.select(F.concat(F.lit("group "), "g").alias("item"), "g", F.lit(0).alias("slot"), alone.alias("total")))
    placed = cut(placed)
    out = placed.select("g", "item", "slot")
    level = placed.where("total is not null").select("item", F.col("total").alias("sums"))
    depth = 1
    while (n := level.count()) > 1:
        light, m = level, 1
        if n > bucket:
            stays = cut(level.orderBy(F.desc(F.array_max("sums") - F.array_min("sums")), "item").limit(bucket // 2))
            light, m = level.join(small_side(stays.select("item")), "item", "left_anti"), buckets_of(n - bucket // 2, bucket)
        step = light.withColumn("up", name(depth, "item", m)).groupBy("up").applyInPandas(_combine(shards), "up string, item string, slots array<int>, total array<long>")
        if n > bucket:
            step = step.unionByName(stays.select(F.col("item").alias("up"), "item", F.sequence(F.lit(0), F.lit(shards - 1)).alias("slots"), F.col("sums").alias("total")))
        step = cut(step)
        ways = step.select("item", "up", "slots")
        out = out.join(small_side(ways) if n * shards <= BROADCAST_SLOTS else ways, "item").select("g", F.col("up").alias("item"), F.col("slots")[F.col("slot")].alias("slot"))
        level = step.where("total is not null").select(F.col("up").alias("item"), F.col("total").alias("sums"))
        depth += 1
    return out.select("g", F.col("slot").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, group: Column | None = None, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, group, bytes, shard) for every row.

    ``group`` is the column of indivisible groups; by default it is the text itself (as a 128-bit hash), so copies
    never come to lie in different shards. A null group is a group, and is another than that of ''. Bytes are those of the text in UTF-8, 0 if null.
    Repeated rows count each and stay together. Groups of equal bytes are taken in the order of their names. An empty
    table gives no rows; shards may stay empty if there are fewer groups. Texts may be of any length; what is read of
    them is their length and their hash. Up to ``bucket`` groups are differenced as one; more are in buckets, and the
    balance is a little less tight, as the README says in figures. Ids keep their type. Other columns aren't read.
    """
    text = F.col(f"`{text_col}`")
    key = F.md5(text) if group is None else group.cast("string")
    # A mark before the name keeps the null group apart, which joins don't match.
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.concat(F.lit("="), key), F.lit("")).alias("g"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    src = cut(src)
    places = partition_groups(src.groupBy("g").agg(F.sum("bytes").alias("bytes")), shards, bucket)
    return src.join(places, "g").select(F.col("id").alias("doc_id"), F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias("group"), "bytes", "shard")
