import random

import numpy as np

from rows import awkward, with_extras
from sparquill.llm import line_dedup as L

SCHEMA = "doc_id long, text string, n_chars long"


def brute(rows):
    """Lines kept by first occurrence, in the order of the distinct (id, text) rows; repeated rows alike."""
    order = sorted({(i is None, i or 0, i, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1]))
    # The operator orders rows of one id by a key; tests have no two texts of one id that share a line.
    seen, kept = set(), {}
    for _, _, i, t in order:
        lines, out = t.split("\n"), []
        dropped = 0
        for line in lines:
            bare = line.strip(" \t\r")
            if bare and bare in seen:
                dropped += 1
                continue
            if bare:
                seen.add(bare)
            out.append(line)
        kept[i, t] = ("\n".join(out), dropped) if not dropped or any(x.strip(" \t\r") for x in out) else None
    return sorted((str(i), *kept[i, t]) if t is not None else (str(i), "", 0) for i, t in rows if t is None or kept[i, t] is not None)


def got(df):
    return sorted((str(r["doc_id"]), r["text"] or "", r["n_dropped"]) for r in df.collect())


def test_against_brute_force(spark):
    r = random.Random(7)
    rows = [(i, "\n".join(r.choice(["", " ", "x", " x ", f"line {r.randrange(60)}", f"own {i} {r.random()}"]) for _ in range(r.randint(0, 12)))) for i in range(120)]
    rows += awkward()[:1] + [(200, None), (201, ""), (None, "line 3\nonly here"), (3, None)]
    df = spark.createDataFrame([(i, t, len(t) if t else 0) for i, t in rows], SCHEMA)
    assert got(L.drop_repeated_lines(df, count_col="n_dropped")) == brute(rows)


def test_awkward_rows_and_extra_columns(spark):
    rows = awkward()
    df = with_extras(spark.createDataFrame([(i, t, len(t) if t else None) for i, t in rows], SCHEMA))
    out = L.drop_repeated_lines(df)
    assert out.columns == df.columns
    kept = out.collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == [x[:2] for x in brute(rows)]
    assert all(r["n_chars"] == len(r["text"]) for r in kept if r["n_chars"] is not None) and all(r["line"] == "x-line" for r in kept)


def test_several_shards_and_copies_of_hot_ones(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_LINES", 50)
    monkeypatch.setattr(L, "SHARD_PROBES", 100)
    r = random.Random(9)
    rows = [(i, "\n".join(["hot line"] + [f"line {r.randrange(500)}" for _ in range(8)])) for i in range(150)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA)
    assert got(L.drop_repeated_lines(df, count_col="n_dropped")) == brute(rows)


def test_perfect_hash_is_minimal():
    r = np.random.default_rng(1)
    h1, h2 = r.integers(-(2**62), 2**62, 20_000), r.integers(-(2**62), 2**62, 20_000)
    levels, bits = L.build_mph(h1, h2)
    at = L.probe_mph(levels, bits, np.cumsum(bits) - 1, h1, h2)
    assert sorted(at.tolist()) == list(range(20_000)) and bits.sum() == 20_000


def test_empty(spark):
    out = L.drop_repeated_lines(spark.createDataFrame([], SCHEMA), count_col="n")
    assert out.count() == 0 and out.columns == ["doc_id", "text", "n_chars", "n"]
