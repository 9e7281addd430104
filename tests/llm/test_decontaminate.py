import random
import re

import numpy as np

from rows import awkward, with_extras, words
from sparquill.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def toks(t):
    return re.findall(r"[^\W_]+", t.lower())


def tiling(doc, item, k):
    """Greedy string tiling as in the textbook, by comparing every pair of places."""
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best, found = k - 1, []
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and free_i[i + n] and free_d[d + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, d)]
                elif n == best and n >= k:
                    found.append((i, d))
        if not found:
            return tiles
        for i, d in found:
            if all(free_i[i : i + best]) and all(free_d[d : d + best]):
                for j in range(best):
                    free_i[i + j] = free_d[d + j] = False
                tiles.append((d, i, best))


def brute(docs, items, k=D.MIN_MATCH, least=D.COVERAGE):
    out = {}
    for d, t in docs:
        for i, x in items:
            if t is None or x is None or i is None or len(toks(x)) < k:
                continue
            tiles = tiling(toks(t), toks(x), k)
            share = sum(n for *_, n in tiles) / len(toks(x))
            if share >= least:
                out[d, i] = max(out.get((d, i), 0), round(share, 6))
    return out


def planted(seed=2):
    r = random.Random(seed)
    items = [(i, words(r, r.randint(8, 40))) for i in range(15)] + [(20, "too short"), (21, None), (None, words(r, 20)), (22, "rose is a rose is a rose is a rose"), (22, "rose is a rose is a rose")]
    docs = []
    for n in range(60):
        w = toks(words(r, r.randint(0, 60)))
        x = toks(r.choice(items[:15])[1])
        kind = n % 4
        if kind == 1:
            w[len(w) // 2 : len(w) // 2] = x
        if kind == 2:  # reordered passages
            cut = len(x) // 2
            w = w[:10] + x[cut:] + w[10:20] + x[:cut] + w[20:]
        if kind == 3:  # some words replaced
            for _ in range(len(x) // 6):
                x[r.randrange(len(x))] = "zzz"
            w += x
        docs.append((n, " ".join(w)))
    return docs + [(70, "a rose is a rose is a rose, is a rose"), (71, "rose " * 50)], items


def got(df):
    return {(r["doc_id"], r["item_id"]): r["coverage"] for r in df.collect()}


def test_against_the_textbook(spark):
    docs, items = planted()
    want = brute(docs, items)
    assert len(want) > 30
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert got(D.contaminated(d, i)) == want
    assert got(D.contaminated(with_extras(d), with_extras(i))) == want


def test_a_benchmark_too_large_to_sift_by(spark, monkeypatch):
    docs, items = planted(5)
    monkeypatch.setattr(D, "SIFTED_SEEDS", 10)
    assert got(D.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))) == brute(docs, items)


def test_tiles_are_those_of_the_textbook():
    r = random.Random(4)
    for _ in range(150):
        item = [r.randrange(6) for _ in range(r.randint(0, 30))]
        doc = [r.choice([-1, *range(6)]) for _ in range(r.randint(0, 60))]
        at = r.randrange(len(doc) + 1)
        doc[at:at] = item[: r.randint(0, 30)]
        assert D.tile(np.array(doc), np.array(item), 3) == tiling(doc, item, 3)


def test_long_repetitive_texts(spark):
    """Eight million shared seeds of one pair."""
    docs = [(1, "so it goes on " * 5000), (2, "so it goes " * 30)]
    assert got(D.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, "so it goes on " * 100)], ITEMS))) == {(1, 1): 1.0}


def test_ids_of_text(spark):
    rows = [("a", "one two three four five"), (None, "one two three four five six"), ("b", "else")]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    i = spark.createDataFrame([("x", "one two three four")], "item_id string, text string")
    assert got(D.contaminated(d, i)) == {("a", "x"): 1.0, (None, "x"): 1.0} and [r["doc_id"] for r in D.drop_contaminated(d, i).collect()] == ["b"]


def test_awkward_rows(spark):
    rows = awkward()
    item = rows[0][1]
    d, i = with_extras(spark.createDataFrame(rows, DOCS)), spark.createDataFrame([(1, item), (1, item)], ITEMS)
    assert {x for x, _ in got(D.contaminated(d, i))} == {1, 2, None, 9}
    left = D.drop_contaminated(d, i)
    assert left.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(a) for a, t in rows if not t or item not in t)


def test_empty(spark):
    d, i = spark.createDataFrame([(1, "a b c d e")], DOCS), spark.createDataFrame([(1, "a b c d e")], ITEMS)
    assert D.contaminated(d.limit(0), i).count() == 0 and D.contaminated(d, i.limit(0)).count() == 0
    assert D.drop_contaminated(d, i.limit(0)).count() == 1 and D.drop_contaminated(d, i).count() == 0
