import itertools
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rows import awkward, with_extras, words
from sparquill.llm import ngram_join as J

SCHEMA = "doc_id long, text string"


def grams(text, n=3):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def linked(rows, threshold=0.5):
    """Pairs of rows, by their numbers, that are similar."""
    sets = [grams(t) for _, t in rows]
    return {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(b)] = find(a)
    return [find(x) for x in range(n)]


def brute(rows, threshold=0.5):
    """Sorted (id, class, links) of all rows."""
    pairs = linked(rows, threshold)
    own = roots(len(rows), pairs)
    n = Counter(x for p in pairs for x in p)
    least = {g: min((rows[x][0] for x in range(len(rows)) if own[x] == g and rows[x][0] is not None), default=None) for g in own}
    return sorted([(i, least[own[x]], n[x]) for x, (i, _) in enumerate(rows)], key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and r.random() < 0.4:
            w = r.choice(rows)[1].split()
            for _ in range(r.randint(0, len(w) // 6)):
                w[r.randrange(len(w))] = words(r, 1)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, words(r, r.randint(1, 80))))
    return rows


def got(df):
    return sorted([(r["doc_id"], r["class_id"], r["n_links"]) for r in df.collect()], key=repr)


def pairs_of(spark, rows):
    """Pairs of row numbers that the operator finds, with their similarities."""
    members, pairs = J.similar_pairs(spark.createDataFrame([(x, t) for x, (_, t) in enumerate(rows)], SCHEMA))
    sets = {}
    for r in members.where("set_id is not null").collect():
        sets.setdefault(r["set_id"], []).append(r["doc_id"])
    out = {p: 1.0 for same in sets.values() for p in itertools.combinations(sorted(same), 2)}
    for r in pairs.collect():
        out |= {(min(a, b), max(a, b)): r["jaccard"] for a in sets[r["set_a"]] for b in sets[r["set_b"]]}
    return out


def test_recall_and_precision(spark):
    rows = corpus(4, 400)
    want, have = linked(rows), pairs_of(spark, rows)
    sets = [grams(t) for _, t in rows]
    assert len(want) > 100 and all(abs(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) - j) < 1e-9 for (a, b), j in have.items())
    assert have.keys() <= want and len(have) >= 0.99 * len(want)
    assert got(J.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_large_buckets_are_split(spark, monkeypatch):
    """Buckets are split by Spark and in tasks, some many times, and verified in blocks; recall holds."""
    monkeypatch.setattr(J, "SMALL", 3)
    monkeypatch.setattr(J, "IN_TASK", 12)
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "HELD_GRAMS", 200)
    r = random.Random(8)
    rows = corpus(5, 150)
    rows += [(1000 + i, "alpha beta gamma delta " + words(r, 20)) for i in range(60)]
    base = words(r, 50)
    rows += [(2000 + i, base + f" end{i}") for i in range(30)]
    want, have = linked(rows), pairs_of(spark, rows)
    assert have.keys() <= want and len(have) >= 0.99 * len(want)


def at_the_threshold(r, n):
    """Pairs of signatures of equal tokens with chance 1/2, all in one bucket and else unlike."""
    sig = r.integers(0, 2**32, (2 * n, J.SLOTS), dtype=np.uint32)
    sig[1::2] = np.where(r.random((n, J.SLOTS)) < 0.5, sig[::2], sig[1::2])
    return sig


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_recall_at_any_depth(depth):
    """Pairs at the threshold survive the runs that are taken, if every bucket is split so often."""
    n = 3000
    sig = at_the_threshold(np.random.default_rng(depth), n)
    found = np.zeros(n, bool)
    for root in J.mix64(np.arange(1, J.runs_for(0.5, 0.99) + 1, dtype=np.uint64)):
        row, path = J.chosen(np.full(2 * n, root, np.uint64), sig, J.fanout(0.5))
        for _ in range(depth - 1):
            # Nodes of one set only can't bring pairs together; they are left out to save time.
            both = np.isin(path, np.intersect1d(path[row % 2 == 0], path[row % 2 == 1]))
            row, path = row[both], path[both]
            at, child = J.chosen(path, J.short(sig)[row], J.fanout(0.5))
            row, path = row[at], child
        left, right = row % 2 == 0, row % 2 == 1
        pairs = set(zip((row[left] // 2).tolist(), path[left].tolist(), strict=True)) & set(zip((row[right] // 2).tolist(), path[right].tolist(), strict=True))
        found[[p for p, _ in pairs]] = True
    passes = (sig[::2] == sig[1::2]).sum(axis=1) >= J.least_equal(0.5)
    assert (found & passes).mean() >= 0.985  # 0.99 but for the error of 3,000 draws


def test_large_buckets_in_a_task_are_exact_where_alike():
    r = np.random.default_rng(3)
    base = r.integers(0, 256, J.SLOTS, dtype=np.uint8)
    sig = np.where(r.random((200, J.SLOTS)) < 0.75, base, r.integers(0, 256, (200, J.SLOTS), dtype=np.uint8)).astype(np.uint8)
    bucket = J._Bucket(sig, np.full(200, 50), 0.5)
    have = {(min(x, y), max(x, y)) for a, b in bucket.pairs(np.arange(200), 5) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    assert have == {(a, b) for a, b in itertools.combinations(range(200), 2) if (sig[a] == sig[b]).sum() >= J.least_equal(0.5)}


def alike(n, seed=3):
    """A bucket of n sets that all pass the sketch with each other, as the candidates' step gets it."""
    r = np.random.default_rng(seed)
    base = r.integers(0, 256, J.SLOTS, dtype=np.uint8)
    sig = np.where(r.random((n, J.SLOTS)) < 0.9, base, r.integers(0, 256, (n, J.SLOTS), dtype=np.uint8)).astype(np.uint8)
    return pa.RecordBatch.from_arrays([pa.array([7] * n), pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array([50] * n, pa.int32()), pa.array([x.tobytes() for x in sig], pa.binary())], ["path", "sid", "side", "size", "sig"])


@pytest.mark.parametrize("side", [0, 3])
def test_pairs_of_a_large_bucket_are_not_held_at_once(side):
    """Memory of a task follows the sets of a bucket and not its pairs: 3.1 million of them are 50 MB in two arrays."""
    n = 2500
    batch = alike(n).set_column(2, "side", pa.array([side] * n, pa.int32()))
    tracemalloc.start()
    pairs = sum(len(out.column("bs").flatten()) if "bs" in out.schema.names else out.num_rows for out in J._candidates(0.5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == n * (n - 1) // 2 and peak < 45e6


def test_lists_hold_each_pair_once(monkeypatch):
    """Lists of two paths over the same sets, sent in parts, are united and put into pairs of blocks."""
    monkeypatch.setattr(J, "HELD_PAIRS", 50)
    monkeypatch.setattr(J, "LISTED", 3)
    n = 60
    batches = [alike(n, k).set_column(0, "path", pa.array([path] * n)) for k, path in enumerate((9, -4))]
    table = pa.Table.from_batches([x for b in batches for x in J._candidates(0.5)(iter([b]))])
    assert max(len(x) for x in table["bs"].to_pylist()) == 3
    rows = table.sort_by([("a", "ascending"), ("path", "ascending")]).combine_chunks().to_batches()
    once = pa.Table.from_batches(list(J._once(iter(rows))))
    pairs = [(path, a, b) for path, a, bs in zip(*once.to_pydict().values(), strict=True) for b in bs]
    assert sorted(pairs) == [(-4, a, b) for a, b in itertools.combinations(range(n), 2)] and max(len(x) for x in once["bs"].to_pylist()) == 3
    split = pa.Table.from_batches(list(J._apart(iter(once.append_column("blocks", pa.array([4] * len(once))).combine_chunks().to_batches()))))
    placed = [(bucket, a, b) for bucket, a, bs in zip(*split.to_pydict().values(), strict=True) for b in bs]
    assert sorted((a, b) for _, a, b in placed) == list(itertools.combinations(range(n), 2)) and len({x[0] for x in placed}) == 10
    blocks = {}
    for bucket, a, b in placed:
        blocks.setdefault(bucket, set()).update((a, b))
    assert max(len(x) for x in blocks.values()) < n


def test_links_of_a_large_group(spark, monkeypatch):
    """A group of near copies is verified by blocks of its pairs, beside pairs of unlike texts; each link counts once."""
    monkeypatch.setattr(J, "BUCKET_PAIRS", 100)
    r = random.Random(12)
    base = words(r, 60).split()
    rows = corpus(13, 60) + [(1000 + i, " ".join(w for w in base if r.random() > 0.06)) for i in range(120)]
    rows += [(2000 + i, rows[60 + i % 7][1]) for i in range(20)]
    want, have = linked(rows), pairs_of(spark, rows)
    assert have.keys() <= want and len(have) >= 0.99 * len(want)
    root = roots(len(rows), have)
    n = Counter(x for p in have for x in p)
    least = {g: min(rows[x][0] for x in range(len(rows)) if root[x] == g) for g in root}
    assert got(J.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA))) == sorted([(i, least[root[x]], n[x]) for x, (i, _) in enumerate(rows)], key=repr)


def test_equal_tokens():
    r = np.random.default_rng(1)
    x, y = r.integers(0, 3, (500, J.SLOTS), dtype=np.uint8), r.integers(0, 3, (500, J.SLOTS), dtype=np.uint8)
    y[0] = x[0]
    assert J.equal_tokens(x, y).tolist() == (x == y).sum(axis=1).tolist()


def test_awkward_rows(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert (2, 1, 4) in want and (7, 6, 1) in want and (None, 1, 4) in want and got(J.ngram_jaccard_join(df)) == want == got(J.ngram_jaccard_join(with_extras(df)))


def test_ids_of_text(spark):
    rows = [(i if i is None else f"a{i}", t) for i, t in awkward()]
    assert got(J.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id string, text string"))) == brute(rows)
    assert J.drop_near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).dtypes == [("doc_id", "string"), ("text", "string")]


def test_one_of_each_group_stays(spark):
    rows = corpus(6, 150) + awkward(3)[5:]
    df = with_extras(spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row int"))
    out = J.drop_near_duplicates(df)
    assert out.columns == df.columns
    left = sorted(r["row"] for r in out.collect())
    # Groups by brute force, on rows and not ids.
    sets = [grams(t) for _, t in rows]
    root = roots(len(rows), linked(rows))
    groups = {}
    for n in range(len(rows)):
        groups.setdefault(root[n] if sets[n] else ("none", n), []).append(n)
    for members in groups.values():
        stay = [n for n in members if n in left]
        assert len(stay) == 1, (members, stay)
        ids = [rows[n][0] for n in members]
        assert rows[stay[0]][0] == min((i for i in ids if i is not None), default=None)


def test_rows_that_repeat_whole(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None), (2, None)], SCHEMA)
    assert J.drop_near_duplicates(df).orderBy("doc_id").collect() == [(1, "a b c d"), (2, None), (2, None)]
    assert got(J.ngram_jaccard_join(df)) == [(1, 1, 2)] * 3 + [(2, 2, 0)] * 2


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    assert {r["node"]: r["root"] for r in J.components(edges).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert J.ngram_jaccard_join(df).count() == 0 and J.drop_near_duplicates(df).count() == 0
