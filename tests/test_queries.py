"""The registered queries of the search engine against the SQL that they equal."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sparquill.functions import text as T
from sparquill.plans import registry

DATA = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = ["tokenize_default", "doc_freqs", "avg_field_length_nulls", "search_or", "search_and_not", "search_prefix_fuzzy", "search_field_boost", "search_nested_and_not_cascade", "match_info", "stored_fields_lookup", "auto_suggest", "process_term_array", "camel_case_tokenize", "stream_ingest", "search_many", "search_many_topk", "search_many_fuzzy", "search_and_gated", "search_camel_case", "search_process_term_array_query"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", FEW)
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    cols = sorted(names)
    mine = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
    theirs = sorted((tuple(r[names.index(c)] for c in cols) for r in want.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(x == (pytest.approx(y, abs=2e-6) if isinstance(y, float) else y) for x, y in zip(a, b, strict=True))


def test_names():
    queries = __spark_entry__.queries()
    assert registry.QUERIES.keys() <= queries.keys() and __spark_entry__.oracle_sql().keys() <= queries.keys()


def test_frequencies_are_clamped(spark):
    out = spark.createDataFrame([(1,), (65535,), (70000,)], "n long").select(T.clamp_frequency(F.col("n")).alias("c"))
    assert [r["c"] for r in out.collect()] == [1, 65535, 65535]


def test_python_functions_as_options(spark):
    from sparquill import IndexOptions, SearchIndex
    from sparquill.functions.callables import document_boost, result_filter

    rows = [(1, "red ring", 5), (2, "red red", 1), (3, "blue", 9)]
    index = SearchIndex.from_dataframe(spark.createDataFrame(rows, "id long, text string, n int"), IndexOptions(fields=("text",), store_fields=("n",)))
    assert [r["id"] for r in index.search("red", filter=result_filter(lambda r: r["n"] > 2 and r["score"] > 0)).collect()] == [1]
    boosted = index.search("red", boost_document=document_boost(lambda i, term, stored: stored["n"] if term == "red" else None))
    assert [r["id"] for r in boosted.collect()] == [1, 2]
    assert [r["id"] for r in index.search("red", boost_document=document_boost(lambda i, term, stored: None)).collect()] == []


def test_numbers_come_first_among_terms(spark):
    from sparquill import IndexOptions, SearchIndex

    index = SearchIndex.from_dataframe(spark.createDataFrame([(1, "abc 10 9 007 abd 4294967295")], "id long, text string"), IndexOptions(fields=("text",)))
    assert index.search("abd abc 10 9 007 4294967295").first()["terms"] == ["9", "10", "abd", "abc", "007", "4294967295"]


def test_lookup_and_lengths(spark):
    from sparquill import IndexOptions, SearchIndex

    index = SearchIndex.from_dataframe(spark.createDataFrame([("a", "x y x"), ("b", None)], "id string, text string"), IndexOptions(fields=("text",)))
    assert index.field_length("a", "text") == 2 and index.field_length("b", "text") == 0 and index.field_length("c", "text") == 0
    ids = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    assert {(r["id"], r["found"]) for r in index.lookup(ids).collect()} == {("a", True), ("z", False), (None, False)}
    assert [r["term"] for r in index.dictionary().collect()] == ["x", "y"]
    with pytest.raises(TypeError):
        index.lookup(spark.createDataFrame([(1,)], "k int"))


def test_texts_of_turns_are_searched(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, 0, "user", "where is the ring"), (1, 0, "user", "der Ring"), (1, 0, "user", "der Ring"), (1, 0, "assistant", "the the red"), (1, 1, "assistant", "nothing"), (2, 0, None, "the end"), (2, 1, "system", None), (None, 0, "user", "the null"), (3, None, "tool", "der")]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    got = {r["key"]: r["score"] for r in registry.QUERIES["search_conversations"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(dict(con.execute(registry.ORACLE_SQL["search_conversations"]).fetchall()), abs=2e-6)
    assert got.keys() == {"1-0-1", "1-0-2", "1-0-3", "2-0-1", "null-0-1", "3-null-1"}
