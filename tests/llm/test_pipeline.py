import random
import re

import numpy as np

import __spark_entry__
import corpus_pipeline
from rows import CLASHES, awkward, letters, with_extras
from sparquill.llm import bpe, registry
from test_decontaminate import brute as leaks
from test_line_dedup import brute as lines
from test_ngram_join import grams
from test_quality import brute as quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path):
    """Documents with planted copies, near copies, repeated lines, leaks and junk, and a benchmark."""
    r = random.Random(11)
    common = letters(r, 40).split()
    item = lambda: letters(r, 25)
    bench = [(i, item()) for i in range(5)]
    said = lambda n: "\n".join(" ".join(r.choice(common) if r.random() < 0.6 else letters(r, 1) for _ in range(12)) for _ in range(n))
    rows = [(i, said(r.randint(2, 14)), "en") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en") for i in range(5)]  # copies
    rows += [(200 + i, re.sub(r"\w+$", "changed", said(1)) + " " + rows[10 + i][1].replace("\n", " "), "en") for i in range(5)]  # near copies
    rows += [(300 + i, said(14) + "\n" + bench[i][1] + "\n" + said(6), "en") for i in range(5)]  # leaks
    rows += [(400 + i, "### $$$ %%% " * 60, "en") for i in range(2)]  # junk
    rows += [(500, None, "en"), (501, "", None), (None, said(4), "en"), (502, "hello", "xx"), (60, rows[3][1] + "\n" + said(8), "en")]
    spark.createDataFrame([(i, t, g, "s", len(t) if t else 0) for i, t, g in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, bench


def test_stages_against_brute_force(spark, tmp_path):
    d = str(tmp_path)
    rows, bench = tables(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{d}/{name}")
        docs, before = spark.read.parquet(f"{d}/{name}"), docs
        kept[name] = ([(r["doc_id"], r["text"]) for r in before.collect()], docs.collect())
    ids = lambda rows: {r["doc_id"] for r in rows}
    given, left = kept["quality_rules"]
    poor = {i for (i, *_), (*_, keep) in zip(rows, quality([(i, g, t) for i, t, g in rows]), strict=True) if not keep}
    assert {i for i, _ in given} - ids(left) == poor and {400, 401, 500, 501} <= poor and not poor & set(range(300, 305))
    given, left = kept["line_dedup"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == sorted(x[:2] for x in lines(given)) and all(r["n_chars"] == len(r["text"]) for r in left)
    assert not ids(left) & set(range(100, 105))
    given, left = kept["ngram_jaccard_join"]
    near = {(i, j) for i, t in given for j, u in given if i is not None and j is not None and i < j and len(grams(t) & grams(u)) >= 0.5 * len(grams(t) | grams(u))}
    assert {i for i, _ in given} - ids(left) == {j for _, j in near} and near
    given, left = kept["benchmark_decontamination"]
    assert {i for i, _ in given} - ids(left) == {i for i, _ in leaks(given, bench)} == set(range(300, 305))
    given, left = kept["bpe"]
    merges = bpe.load(bpe.VOCABULARY)
    assert sorted((str(r["doc_id"]), bpe.decode_bytes(np.array(r["token_ids"]), merges).decode()) for r in left) == sorted((str(i), t) for i, t in given)
    assert sorted(map(str, corpus_pipeline.run(spark, d).collect())) == sorted(map(str, left))


def test_awkward_rows(spark, tmp_path):
    """Every stage takes nulls, empty and very long texts, repeated rows, and columns of clashing names."""
    d = str(tmp_path)
    base = " ".join(f"w{'abcdefgh'[i % 8]}x{'klmnopq'[i % 7]}" for i in range(70))
    rows = [(i, t, "en", "s", 0) for i, t in awkward()] + [(60, base + "\n" + base[:50], None, None, None), (61, "so it goes on " * 30_000, "en", "s", 1)]
    docs = with_extras(spark.createDataFrame(rows, DOCS))
    docs.write.parquet(f"{d}/documents.parquet")
    with_extras(spark.createDataFrame([(1, "so it goes on and on"), (None, None), (2, None)], "item_id long, text string")).write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{d}/{name}")
        docs, before = spark.read.parquet(f"{d}/{name}"), docs.count()
        assert 0 < docs.count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == docs.count()


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_registry():
    names = __spark_entry__.queries().keys()
    assert registry.QUERIES.keys() <= names and registry.ORACLE_SQL.keys() <= registry.QUERIES.keys() and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n != "pipeline") == list(range(1, 11)) and len(set(CLASHES)) == len(CLASHES)
