import json
import random

import pytest
from pyspark.sql import functions as F

from oracle import Index, words
from sparquill import AND, AND_NOT, OR, WILDCARD, BM25, Combination, IndexBuilder, IndexOptions, SearchIndex, get_default
from sparquill.functions import text as T

DOCS = [(1, "Moby Dick", "Call me Ishmael whale sea", "fiction"), (2, "Zen Motorcycle", "zen art motorcycle maintenance", "fiction"), (3, "Neuromancer", "cyberspace matrix hacker", "sci-fi"), (4, "Zen Archery", "zen archery art practice", "non-fiction")]
SCHEMA = "id long, title string, text string, category string"
OPTIONS = IndexOptions(fields=("title", "text"), store_fields=("title", "category"))


@pytest.fixture(scope="module")
def index(spark):
    return SearchIndex.from_dataframe(spark.createDataFrame(DOCS, SCHEMA), OPTIONS).cache()


def hits(df):
    return [(r["id"], round(r["score"], 6)) for r in df.collect()]


def test_statistics(index):
    assert index.document_count == 4 and index.term_count == 17
    assert index.tables.averages == (1.75, 4.0)
    assert index.faults().count() == 0
    assert {r["component"]: r["rows"] for r in index.stats().collect()}["documents"] == 4


@pytest.mark.parametrize(
    ("query", "options", "expected"),
    [
        ("zen", {}, [(2, 2.043589), (4, 2.043589)]),
        ("zen", {"boost": {"title": 2}}, [(2, 3.047457), (4, 3.047457)]),
        ("zen", {"boost": {"title": 0}}, [(2, 2.043589), (4, 2.043589)]),
        ("zen", {"fields": ["title"]}, [(2, 1.003868), (4, 1.003868)]),
        ("zen", {"fields": ["nothing"]}, []),
        ("zen zen", {}, [(2, 4.087178), (4, 4.087178)]),
        ("zen whale", {"combine_with": "OR"}, [(2, 2.043589), (4, 2.043589), (1, 1.701049)]),
        ("zen art", {"combine_with": AND}, [(2, 6.166620), (4, 6.166620)]),
        ("zen art", {"combine_with": AND_NOT}, []),
        ("zen motorcycle", {"combine_with": AND_NOT}, [(4, 2.043589)]),
        ("neur", {"prefix": True}, [(3, 0.642845)]),
        ("neuromancr", {"fuzzy": 0.3}, [(3, 0.842127)]),
        (Combination(["zen", Combination(["motorcycle", "archery"], combine_with=OR)], combine_with=AND), {}, [(2, 11.186466), (4, 11.186466)]),
        ("", {}, []),
        ("...", {}, []),
    ],
)
def test_scores(index, query, options, expected):
    assert hits(index.search(query, **options)) == expected


def test_result_columns(index):
    r = index.search("zen archery", prefix=True).first()
    assert r["id"] == 4 and r["terms"] == ["zen", "archery"] and r["query_terms"] == ["zen", "archery"]
    assert r["match"] == {"zen": ["title", "text"], "archery": ["title", "text"]}
    assert r["title"] == "Zen Archery" and r["category"] == "non-fiction"


def test_cascade_of_options(index):
    # Words of a member inherit the combination's operator.
    q = Combination(["zen", "art motorcycle"], combine_with=AND)
    assert [i for i, _ in hits(index.search(q))] == [2]
    q = Combination(["zen", Combination(["motorcycle", "ocean"], combine_with=OR)], combine_with=AND_NOT)
    assert [i for i, _ in hits(index.search(q))] == [4]


def test_filter_wildcard_and_limit(index):
    assert [i for i, _ in hits(index.search(WILDCARD))] == [1, 2, 3, 4]
    assert [i for i, _ in hits(index.search(WILDCARD, filter="category = 'fiction'"))] == [1, 2]
    assert [i for i, _ in hits(index.search("zen", filter=lambda df: df["category"] != "fiction"))] == [4]
    assert len(hits(index.search(WILDCARD, limit=2))) == 2
    # Within a combination a filter isn't heard.
    assert len(hits(index.search(Combination(["zen"], filter="category = 'none'")))) == 2
    boosted = index.search(WILDCARD, boost_document=lambda i, term, stored: F.when(i == 3, F.lit(5.0)).otherwise(F.lit(0.0)))
    assert hits(boosted)[0] == (3, 5.0) and len(hits(boosted)) == 4
    assert [i for i, _ in hits(index.search(Combination([WILDCARD, "zen"], combine_with=AND_NOT)))] == [1, 3]


def test_boosts(index):
    assert hits(index.search("zen", boost_term=lambda t, i, ts: 2.0)) == [(2, 4.087178), (4, 4.087178)]
    assert [i for i, _ in hits(index.search("zen", boost_document=lambda i, term, stored: F.when(stored["category"] == "fiction", 0).otherwise(3)))] == [4]
    # What is dropped by a boost still excludes.
    assert hits(index.search("zen motorcycle", combine_with=AND_NOT, boost_document=lambda i, t, s: F.when(t == "motorcycle", 0).otherwise(1))) == [(4, 2.043589)]
    assert hits(index.search("zen", bm25=BM25(1.2, 0.7, 0.5))) == [(2, 2.043589), (4, 2.043589)]


def test_ties_of_fuzzy_and_prefix(spark):
    rows = [(1, "bara"), (2, "barb"), (3, "barc")]
    ix = SearchIndex.from_dataframe(spark.createDataFrame(rows, "id long, text string"), IndexOptions(fields=("text",)))
    assert [i for i, _ in hits(ix.search("bar", prefix=True))] == [1, 2, 3]
    assert [i for i, _ in hits(ix.search("bard", fuzzy=1))] == [3, 2, 1]


def test_suggestions(index):
    assert [(r["suggestion"], r["terms"]) for r in index.auto_suggest("zen ar").collect()] == [("zen archery art", ["zen", "archery", "art"]), ("zen art", ["zen", "art"])]
    assert [r["suggestion"] for r in index.auto_suggest("zen ar", filter="category = 'fiction'").collect()] == ["zen art"]


def test_lookup(index):
    assert index.has(2) and not index.has(9) and not index.has("2") and not index.has(None)
    assert index.get_stored_fields(3) == {"title": "Neuromancer", "category": "sci-fi"}
    assert index.get_stored_fields(9) is None


def test_errors(spark, index):
    for bad in (None, 3, object()):
        with pytest.raises(TypeError):
            index.search(bad)
    with pytest.raises(ValueError, match="invalid combination operator"):
        index.search("zen", combine_with="XOR")
    with pytest.raises(TypeError):
        index.search("zen", colour="red")
    with pytest.raises(ValueError, match="duplicate ID"):
        SearchIndex.from_dataframe(spark.createDataFrame(DOCS + DOCS[:1], SCHEMA), OPTIONS)
    with pytest.raises(ValueError, match="no ID"):
        SearchIndex.from_dataframe(spark.createDataFrame([(None, "a", "b", "c")], SCHEMA), OPTIONS)
    with pytest.raises(ValueError):
        IndexOptions(fields=("a",), store_fields=("score",))
    with pytest.raises(KeyError):
        get_default("nothing")
    assert get_default("id_field") == "id"


def test_null_fields(spark):
    rows = [(1, "alpha beta", "one two"), (2, None, "three four"), (3, "gamma", "five six")]
    ix = SearchIndex.from_dataframe(spark.createDataFrame(rows, "id long, title string, text string"), IndexOptions(fields=("title", "text")))
    assert [round(a, 6) for a in ix.tables.averages] == [1.666667, 2.0]
    assert hits(ix.search("alpha gamma")) == [(3, 1.648046), (1, 1.401658)]


def test_empty_index(spark):
    ix = SearchIndex.from_dataframe(spark.createDataFrame([], SCHEMA), OPTIONS)
    assert hits(ix.search("zen")) == [] and hits(ix.search(WILDCARD)) == [] and ix.document_count == 0


def test_custom_analyzers(spark):
    df = spark.createDataFrame([("a", "the createUser thing", ["x", "y"]), ("b", "ComboTerm", ["y"])], "id string, text string, tags array<string>")
    ix = SearchIndex.from_dataframe(df, IndexOptions(fields=("text", "tags"), tokenize=T.camel_case_tokenize, process_term=T.stop_words(["the"])))
    assert [i for i, _ in hits(ix.search("create"))] == ["a"] and hits(ix.search("the")) == [] and len(hits(ix.search("y"))) == 2
    arrays = SearchIndex.from_dataframe(df, IndexOptions(fields=("text",), process_term=lambda t: F.when(t == "ComboTerm", F.array(F.lit("combo"), F.lower(t))).otherwise(F.array(F.lower(t))), term_arrays=True))
    assert [i for i, _ in hits(arrays.search("combo"))] == ["b"]
    assert [i for i, _ in hits(arrays.search("X", process_term=lambda t: ["combo", ""]))] == ["b"]


def test_tokens_agree(spark):
    texts = ["", "::a", "a::", "a\tb", "a\nb\r\nc", "em—dash", "été où", "a_b-c", "$5 + <b> ~x|y`", "  ", "Hello, world!"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokenize(F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in rows} == {t: T.tokenize_text(t) for t in texts}
    assert T.tokenize_text("Hello, world!") == ["Hello", "world", ""]


def test_random_against_oracle(spark):
    r = random.Random(5)
    docs = [{"id": i, "title": words(r, r.randint(0, 4)) if r.random() < 0.8 else None, "text": words(r, r.randint(1, 12))} for i in range(40)]
    ix = SearchIndex.from_dataframe(spark.createDataFrame(docs, "id long, title string, text string"), IndexOptions(fields=("title", "text"))).cache()
    plain = Index(docs, ["title", "text"])
    for a, b in zip(ix.tables.averages, plain.avg, strict=True):
        assert a == pytest.approx(b, abs=1e-6)
    cases = [("alpha", {}), ("alp", {"prefix": True}), ("alph gam", {"prefix": True, "fuzzy": 0.3}), ("beta delta", {"combine_with": "and"}), ("beta gamma", {"combine_with": "and_not", "fuzzy": 1}), ("thet", {"fuzzy": True, "boost": {"title": 3}}), ("delta", {"fields": ["text"], "prefix": True})]
    nested = (["alpha", (["beta", "gam"], {"combine_with": "or", "prefix": True})], {"combine_with": "and"})
    for q, o in [*cases, (nested, {})]:
        mine = Combination([q[0][0], Combination(q[0][1][0], **q[0][1][1])], **q[1]) if isinstance(q, tuple) else q
        got = {x["id"]: (x["score"], frozenset(x["terms"])) for x in ix.search(mine, **o).collect()}
        want = plain.search(q, **o)
        assert got.keys() == want.keys(), (q, o)
        for i in want:
            assert got[i][0] == pytest.approx(want[i][0], abs=1e-6) and got[i][1] == want[i][1]


def test_batch_equals_single(spark, index):
    qs = [(1, "zen"), (2, "zen archery"), (3, "zen zen"), (4, ""), (5, None), (6, "motorcycl neurom")]
    for o in ({}, {"combine_with": AND}, {"combine_with": AND_NOT}, {"prefix": True, "fuzzy": 0.2}):
        got = {}
        for r in index.search_many(spark.createDataFrame(qs, "query_id int, query string"), **o).collect():
            got.setdefault(r["query_id"], {})[r["id"]] = round(r["score"], 6)
        for i, q in qs:
            assert got.get(i, {}) == dict(hits(index.search(q or "", **o))), (q, o)


def test_plans(index):
    plan = index.search("zen", limit=3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    q = index.search("zen motorcycle", combine_with=AND_NOT)._jdf.queryExecution().toString()
    assert "LeftAnti" in q


def test_builder(spark):
    b = IndexBuilder(spark, OPTIONS, estimated_document_count=4)
    rows = [dict(zip(("id", "title", "text", "category"), d, strict=True)) for d in DOCS]
    b.add(rows[0], SCHEMA).add_all_in_chunks(rows[1:], 2, SCHEMA)
    with pytest.raises(ValueError):
        b.add_all_in_chunks(rows, 0)
    assert b.document_count == 4
    assert hits(b.freeze().search("zen")) == [(2, 2.043589), (4, 2.043589)]
    with pytest.raises(RuntimeError):
        b.add(rows[0])
    with pytest.raises(RuntimeError):
        b.freeze()


def test_store(spark, index, tmp_path):
    index.save(str(tmp_path / "ix"), "zlib")
    back = SearchIndex.load(spark, str(tmp_path / "ix"))
    assert hits(back.search("zen archery", prefix=True)) == hits(index.search("zen archery", prefix=True))
    assert back.get_stored_fields(3) == index.get_stored_fields(3)
    with pytest.raises(ValueError):
        SearchIndex.load(spark, str(tmp_path / "ix"), IndexOptions(fields=("title",)))
    with pytest.raises(ValueError):
        index.save(str(tmp_path / "no"), "lzma")
    plan = back.search("ze", prefix=True)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in plan


def test_json(spark, index):
    text = index.to_json()
    s = json.loads(text)
    assert s["documentCount"] == 4 and s["serializationVersion"] == 2 and len(s["index"]) == 17
    back = SearchIndex.from_json(spark, text)
    assert hits(back.search("zen whale")) == hits(index.search("zen whale"))
    assert back.get_stored_fields(3) == {"title": "Neuromancer", "category": "sci-fi"}


def snapshot(**change):
    base = {"documentCount": 2, "nextId": 3, "documentIds": {"0": "a", "2": "c"}, "fieldIds": {"t": 0}, "fieldLength": {"0": [1], "2": [1]}, "averageFieldLength": [1], "storedFields": {}, "index": [["alpha", {"0": {"0": 1}}], ["gone", {"0": {"1": 1}}], ["gamma", {"0": {"2": 1}}]], "serializationVersion": 2}
    return json.dumps({**base, **change})


def test_json_sparse_and_v1(spark):
    ix = SearchIndex.from_json(spark, snapshot())
    assert [i for i, _ in hits(ix.search("gamma"))] == ["c"] and hits(ix.search("gone")) == []
    v1 = SearchIndex.from_json(spark, snapshot(serializationVersion=1, index=[["hello", {"0": {"ds": {"0": 2}}}]]))
    assert [i for i, _ in hits(v1.search("hello"))] == ["a"]


@pytest.mark.parametrize("change", [{"serializationVersion": 9}, {"documentCount": 5}, {"averageFieldLength": []}, {"averageFieldLength": [-1]}, {"fieldIds": {"t": 1}}, {"fieldLength": {"0": [1]}}, {"index": [["a", {"0": {"0": 0}}]]}, {"index": [["a", {"4": {"0": 1}}]]}, {"index": [["a", {}], ["a", {}]]}, {"index": {}}, {"documentIds": {"01": "a"}}, {"storedFields": {"1": {}}}])
def test_json_faults(spark, change):
    with pytest.raises(ValueError):
        SearchIndex.from_json(spark, snapshot(**change))


def test_stream(spark, index, tmp_path):
    from sparquill.streaming.ingest import index_stream

    spark.createDataFrame(DOCS[:2], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    first = index_stream(stream(), OPTIONS, str(tmp_path / "t"), str(tmp_path / "c"))
    assert first.document_count == 2
    spark.createDataFrame(DOCS[2:], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    both = index_stream(stream(), OPTIONS, str(tmp_path / "t"), str(tmp_path / "c"))
    assert hits(both.search("zen whale")) == hits(index.search("zen whale"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lengths_are_taken_below_the_explode(index):
    """A document's distinct tokens are counted once, not once for each of its tokens."""
    lines = plan_of(index.tables.postings.groupBy().count()).splitlines() + plan_of(index.tables.postings).splitlines()
    generate = [n for n, x in enumerate(lines) if "Generate explode" in x]
    assert generate
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    for n, x in enumerate(lines):
        if "array_distinct" in x:
            assert any(m < n and depth(lines[m]) < depth(x) for m in generate)


def test_both_ways_of_asking_agree_for_every_analyzer(spark):
    rows = [(1, "createUser deletes theUser"), (2, "create a user"), (3, "User list of users"), (4, "the end")]
    docs = spark.createDataFrame(rows, "id long, text string")
    queries = spark.createDataFrame([(0, "createUser"), (1, "the user"), (2, "")], "query_id long, query string")
    doubled = IndexOptions(fields=("text",), process_term=lambda t: F.array(F.lower(t), F.reverse(F.lower(t))), term_arrays=True)
    for o in (IndexOptions(fields=("text",)), IndexOptions(fields=("text",), tokenize=T.camel_case_tokenize), IndexOptions(fields=("text",), process_term=T.stop_words(["the"])), doubled, IndexOptions(fields=("text",), tokenize=lambda text, field="": F.split(text, "e", -1))):
        ix = SearchIndex.from_dataframe(docs, o)
        many = {}
        for r in ix.search_many(queries).orderBy("query_id", "rank").collect():
            many.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
        for q in queries.collect():
            assert hits(ix.search(q["query"])) == many.get(q["query_id"], [])
    # What a search says itself goes before the index's own.
    ix = SearchIndex.from_dataframe(docs, IndexOptions(fields=("text",), tokenize=T.camel_case_tokenize))
    assert {i for i, _ in hits(ix.search("createUser"))} == {1, 2, 3} and hits(ix.search("createUser", tokenize=lambda q: [q]))[0][0] == 1 and len(hits(ix.search("createUser", tokenize=lambda q: [q]))) == 1


def test_fuzzy_terms_of_many_queries(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(6))) for i in range(60)]
    ix = SearchIndex.from_dataframe(spark.createDataFrame(rows, "id long, text string"), IndexOptions(fields=("text",)))
    asked = [(i, word()) for i in range(25)]
    for fuzzy in (0.2, 0.5, 1, 3):
        many = {}
        for x in ix.search_many(spark.createDataFrame(asked, "query_id long, query string"), fuzzy=fuzzy).collect():
            many.setdefault(x["query_id"], {})[x["id"]] = round(x["score"], 6)
        for i, q in asked[:: 5]:
            assert dict(hits(ix.search(q, fuzzy=fuzzy))) == many.get(i, {})


def test_and_is_gated_by_the_rarest_term(spark):
    rows = [(i, "common token" if i else "common alpha unique") for i in range(200)]
    ix = SearchIndex.from_dataframe(spark.createDataFrame(rows, "id long, text string"), IndexOptions(fields=("text",)))
    found = ix.search("common unique", combine_with=AND)
    assert [i for i, _ in hits(found)] == [0] and "LeftSemi" in plan_of(found)
    assert "LeftSemi" not in plan_of(ix.search("common token", combine_with=AND)) and hits(ix.search("common nowhere", combine_with=AND)) == []
    assert hits(ix.search(Combination(["common unique", "alpha"], combine_with=AND)))[0][0] == 0


def test_ties_keep_their_order(spark):
    """Scores of equal documents are equal to the last bit, however rows are dealt."""
    text = "alpha beta gamma delta beta zeta eta theta " * 3
    rows = [(i, text, text[::-1]) for i in range(12)]
    o = IndexOptions(fields=("text", "more"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            ix = SearchIndex.from_dataframe(spark.createDataFrame(rows, "id long, text string, more string").repartition(n), o)
            assert [x["id"] for x in ix.search("alpha beta zet gamma ahpla", prefix=True, fuzzy=0.3, limit=5).collect()] == [0, 1, 2, 3, 4]
            q = spark.createDataFrame([(1, "alpha beta zeta gamma ahpla")], "query_id long, query string")
            assert [x["id"] for x in ix.search_many(q, limit=5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_running_average_with_gaps(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 5 + 1)) if i % 3 else None) for i in range(1, 40)]
    ix = SearchIndex.from_dataframe(spark.createDataFrame(rows, "id string, text string"), IndexOptions(fields=("text",)))
    avg = 0.0
    for n, (_, t) in enumerate(sorted(rows, key=lambda x: str(x[0]))):
        if t is not None:
            avg = (avg * n + len(t.split())) / (n + 1)
    assert ix.tables.averages[0] == pytest.approx(avg, rel=1e-6)


def test_a_snapshot_in_parts(spark, index, tmp_path):
    rows = [(i, "the end" if i % 3 else None, f"the \"quoted\" té {i} the") for i in range(40)]
    gaps = SearchIndex.from_dataframe(spark.createDataFrame(rows, "id long, title string, text string"), IndexOptions(fields=("title", "text"), store_fields=("title",)))
    for n, ix in enumerate((index, gaps)):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        ix.save_json(str(tmp_path / f"parts{n}"))
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        files = sorted(p for p in (tmp_path / f"parts{n}").iterdir() if p.name.startswith("part-"))
        assert len(files) > 1
        text = "".join(p.read_text() for p in files)
        assert json.loads(text) == json.loads(ix.to_json())
        assert hits(SearchIndex.from_json(spark, text, ix.options).search("zen the", prefix=True)) == hits(ix.search("zen the", prefix=True))


def test_terms_are_counted_within_their_documents(spark):
    """No task gathers the postings of many documents to count them."""
    rows = [(1, "b a b", None), (2, "", "x"), (3, None, "A a"), (4, " , ", "b " * 70_000)]
    ix = SearchIndex.from_dataframe(spark.createDataFrame(rows, "id long, t string, u string"), IndexOptions(fields=("t", "u")))
    plan = plan_of(ix.tables.bare)
    assert not any(x in plan for x in ("Aggregate", "Exchange", "Sort"))
    assert {(r["doc_ord"], r["field_id"], r["term"], r["tf"], r["len"]) for r in ix.tables.bare.collect()} == {(1, 0, "a", 1, 2), (1, 0, "b", 2, 2), (2, 1, "x", 1, 1), (3, 1, "a", 2, 2), (4, 1, "b", 65535, 2)}
    assert ix.tables.size == 5 and {(r["doc_ord"], r["field_id"], r["len"]) for r in ix.tables.lengths.collect()} == {(1, 0, 2), (1, 1, None), (2, 0, 1), (2, 1, 1), (3, 0, None), (3, 1, 2), (4, 0, 1), (4, 1, 2)}


def test_work_is_dealt_by_size(spark, monkeypatch, tmp_path):
    """Partitions follow the number of postings, whatever the session's number of partitions is."""
    from sparquill.operators import build, search

    monkeypatch.setattr(build, "ROWS", 50)
    monkeypatch.setattr(search, "HIT_ROWS", 20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(i, " ".join(f"w{i + j}" for j in range(5)) + " all") for i in range(100)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        ix = SearchIndex.from_dataframe(spark.createDataFrame(rows, "id long, text string"), IndexOptions(fields=("text",)))
        assert ix.tables.size == 600 and ix.tables.terms.rdd.getNumPartitions() == 12
        ix.save(str(tmp_path / "ix"))
        assert len(list((tmp_path / "ix" / "postings").glob("part-*"))) > 6
        back = SearchIndex.load(spark, str(tmp_path / "ix"))
        for i in (ix, back):
            assert "REPARTITION_BY_NUM" in plan_of(i.search("all w1", prefix=True))
            assert len(hits(i.search("all w1", prefix=True))) == 100 and i.faults().count() == 0
        # Terms too many to be broadcast go by a shuffle.
        expected = hits(ix.search("all w1", prefix=True, fuzzy=0.3))
        monkeypatch.setattr(search, "TERM_ROWS", 3)
        assert hits(ix.search("all w1", prefix=True, fuzzy=0.3)) == expected == hits(back.search("all w1", prefix=True, fuzzy=0.3))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edit_distances_meet_postings_by_broadcast(index):
    plan = plan_of(index.search("zenn", fuzzy=1))
    assert "BroadcastHashJoin" in plan and "levenshtein" not in plan


def test_faults_are_found(spark):
    from dataclasses import replace

    ix = SearchIndex.from_dataframe(spark.createDataFrame([(1, "a b"), (2, "b")], "id long, text string"), IndexOptions(fields=("text",)))
    t = ix.tables
    bad = t.postings.select("term", "field_id", "doc_ord", "tf", "len", "df").unionByName(spark.createDataFrame([("z", 0, 9, 0, 1, 5), ("b", 3, 9, 1, 1, 1), ("b", 0, 8, 1, 1, 2)], "term string, field_id int, doc_ord long, tf int, len int, df long"))
    broken = SearchIndex(replace(t, postings=bad, counted=None, size=None, terms=t.terms.unionByName(t.terms.where("term = 'a'"))), ix.options)
    assert {r["fault"]: r["n"] for r in broken.faults().collect()} == {"posting of no document": 3, "frequency below 1": 1, "field out of range": 1, "duplicate term": 1, "document frequency": 2}
    # Postings are read once for what each row shows.
    assert plan_of(ix.faults()).count("Join") <= 2


def test_a_snapshot_in_parts_is_read_where_it_lies(spark, index, tmp_path, monkeypatch):
    """Blocks of files start amid terms; nothing but what the index has once goes through the driver."""
    rows = [(3 * i, "the end" if i % 3 else None, f"the \"quoted\" té\\ {i} the [x], {{y", i / 2 if i % 4 else None, i % 2 == 0, [f"a{i}"]) for i in range(60)]
    gaps = SearchIndex.from_dataframe(spark.createDataFrame(rows, "id long, title string, text string, half double, even boolean, tags array<string>"), IndexOptions(fields=("title", "text"), store_fields=("title", "half", "even", "tags")))
    named = SearchIndex.from_dataframe(spark.createDataFrame([("a\"b", "x"), ("ü", "x y")], "id string, t string"), IndexOptions(fields=("t",)))
    monkeypatch.setattr(SearchIndex, "from_json", lambda *a: pytest.fail("read on the driver"))
    # Numbers with gaps are looked up, in a table too large to be broadcast; postings are taken apart a few lines at a time.
    monkeypatch.setattr("sparquill.sources.snapshot.FEW", 5)
    monkeypatch.setattr("sparquill.sources.snapshot.TEXT", 100)
    settings = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "20"}
    for n, (ix, q) in enumerate(((index, "zen the"), (gaps, "the 7"), (named, "x"))):
        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            ix.save_json(str(tmp_path / f"s{n}"))
            back = SearchIndex.load_json(spark, str(tmp_path / f"s{n}"), ix.options if n == 0 else None)
            table = lambda df: sorted(map(tuple, df.collect()), key=repr)
            order = {r["doc_ord"]: i for i, r in enumerate(ix.tables.docs.orderBy("doc_ord").collect())}
            cols = ["doc_ord", "term", "field_id", "tf", "len", "df"]
            assert table(back.tables.postings.select(cols)) == sorted(((order[x[0]], *x[1:]) for x in ix.tables.postings.select(cols).collect()), key=repr)
        finally:
            for k in settings:
                spark.conf.unset(k)
        assert hits(back.search(q, prefix=True, fuzzy=0.2)) == hits(ix.search(q, prefix=True, fuzzy=0.2)) and back.tables.averages == ix.tables.averages
        first = ix.tables.docs.orderBy("doc_ord").first()["ext_id"]
        assert back.get_stored_fields(first) == ix.get_stored_fields(first) or n == 2
        text = "".join(p.read_text() for p in sorted((tmp_path / f"s{n}").glob("part-*")))
        assert json.loads(text) == json.loads(ix.to_json())


def test_faults_of_a_snapshot_in_parts(spark, index, tmp_path):
    index.save_json(str(tmp_path / "s"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*")))
    for n, (old, new) in enumerate((('"1":2', '"0":2'), ('"zen"', '"art"'), ('"0": 1', '"9": 1'), (': 1', ': 0'), ('"nextId": 4', '"nextId": 5'), ('[2,4]', '[2,-4]'), ('}, "index": [', "nothing"))):
        (tmp_path / f"bad{n}").mkdir()
        assert old in text
        (tmp_path / f"bad{n}" / "part-0.txt").write_text(new.join(text.rsplit(old, 1)))
        with pytest.raises(Exception, match="SnapshotError|shortId|duplicated|posting|cover|fieldLength"):
            SearchIndex.load_json(spark, str(tmp_path / f"bad{n}"))
