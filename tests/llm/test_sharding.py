import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rows import awkward, with_extras
from sparquill.llm import sharding as S

SCHEMA = "doc_id long, text string"


def plain(values, k):
    """Differencing with explicit sets."""
    parts = [([v] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)], i) for i, v in enumerate(values)]
    n = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][0] - p[0][-1]), p[2]))
        (a, sa, _), (b, sb, _) = parts[:2]
        joined = sorted(((a[j] + b[k - 1 - j], j, sa[j] + sb[k - 1 - j]) for j in range(k)), key=lambda x: (-x[0], x[1]))
        parts = parts[2:] + [([x[0] for x in joined], [x[2] for x in joined], n)]
        n += 1
    return parts[0][0]


def test_differencing():
    r = random.Random(1)
    for k, n in ((2, 9), (3, 30), (4, 101), (5, 3), (3, 1)):
        values = [r.randint(0, 10_000) for _ in range(n)]
        sums = np.zeros((n, k), np.int64)
        sums[:, 0] = values
        slot, total = S.difference(sums)
        assert total.tolist() == plain(values, k) and all(sorted(row) == list(range(k)) for row in slot.tolist())
        assert np.bincount(slot[:, 0], weights=values, minlength=k).tolist() == total.tolist()


def test_balance_over_several_buckets(spark):
    r = random.Random(2)
    rows = [(i, "x" * int(r.paretovariate(1.2) * 50)) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    for bucket in (10_000, 100, 40, 5):
        out = S.shard_documents(df, shards=4, group=F.col("doc_id"), bucket=bucket).groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
        sizes, total = [x["b"] for x in out], sum(len(t) for _, t in rows)
        best = max(max(len(t) for _, t in rows), total / 4)
        assert sum(sizes) == total and max(sizes) <= best * (1.001 if bucket >= 100 else 1.05 if bucket >= 40 else 1.2)


def test_awkward_rows(spark):
    rows = awkward()
    out = S.shard_documents(with_extras(spark.createDataFrame(rows, SCHEMA)), shards=3).collect()
    assert len(out) == len(rows) and {r["shard"] for r in out} <= {0, 1, 2}
    assert sorted(r["bytes"] for r in out) == sorted(len((t or "").encode()) for _, t in rows)
    of = {}
    for r in out:
        of.setdefault(r["group"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in of.values()) and len(of) == len({t for _, t in rows})


def test_a_group_column_that_clashes(spark):
    df = spark.createDataFrame([(1, "aa", "u"), (2, "b", "u"), (3, "cc", None), (4, None, None), (5, "dddd", "")], "doc_id long, text string, g string")
    out = S.shard_documents(df, shards=2, group=F.col("g")).collect()
    assert {(r["doc_id"], r["group"], r["bytes"]) for r in out} == {(1, "u", 2), (2, "u", 1), (3, None, 2), (4, None, 0), (5, "", 4)}
    assert len({r["shard"] for r in out if r["group"] == "u"}) == 1 and len({r["shard"] for r in out if r["group"] is None}) == 1
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["bytes"]
    assert sorted(sizes.values()) == [4, 5]


def levels(values, shards, bucket):
    """Both levels without Spark: buckets are differenced, then what they leave and what is too heavy for them. Gives the shard of each group."""
    heavy = set(sorted(values, key=lambda g: (-values[g][0], g))[: bucket // 2]) if len(values) > bucket else set()
    n = -(-(len(values) - len(heavy)) // bucket)
    members = {}
    for g, (_, h) in values.items():
        members.setdefault(f"group {g}" if g in heavy else f"bucket 0 {h % n}", []).append(g)
    at, left = {}, {}
    for item, own in members.items():
        own.sort()
        sums = np.zeros((len(own), shards), np.int64)
        sums[:, 0] = [values[g][0] for g in own]
        slot, left[item] = (S.difference(sums)) if item.startswith("bucket") else (np.arange(shards)[None], sums[0])
        at |= {g: (item, int(slot[x, 0])) for x, g in enumerate(own)}
    if not heavy:
        return {g: s for g, (_, s) in at.items()}
    names = sorted(left)
    slot, _ = S.difference(np.array([left[x] for x in names]))
    return {g: int(slot[names.index(item), s]) for g, (item, s) in at.items()}


def test_levels_against_the_same_without_spark(spark):
    r = random.Random(4)
    rows = [(i, "x" * int(r.paretovariate(1.2) * 50)) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    keys = df.select(F.col("doc_id"), F.xxhash64(F.concat(F.lit("="), F.col("doc_id").cast("string"))).alias("h")).collect()
    hashed = {x["doc_id"]: x["h"] for x in keys}
    for bucket in (1000, 60, 40):
        out = {x["group"]: x["shard"] for x in S.shard_documents(df, shards=4, group=F.col("doc_id"), bucket=bucket).collect()}
        want = levels({f"={i}": (len(t), hashed[i]) for i, t in rows}, 4, bucket)
        assert out == {g[1:]: s for g, s in want.items()}


def test_empty(spark):
    assert S.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
