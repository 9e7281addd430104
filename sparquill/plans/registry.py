"""Queries of the search engine over the test tables, with the SQL that they equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scoring import BM25
from ..index import IndexBuilder, SearchIndex, build_from_documents, create_builder
from ..operators.build import IndexOptions
from ..sources.store import work_folder
from . import oracle as Q
from .query import AND, AND_NOT, OR, WILDCARD, Combination

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

STORED = ("lang", "source", "n_chars")
DOCUMENTS = IndexOptions(fields=("text",), id_field="doc_id", store_fields=STORED)
TEXT = Q.Corpus("documents", "doc_id", (("text", "text"),))
TWO_FIELDS = IndexOptions(fields=("text", "source"), id_field="doc_id", store_fields=STORED)
TEXT_SOURCE = Q.Corpus("documents", "doc_id", (("text", "text"), ("source", "source")))
#: Texts of other languages than English are null.
GAPS = IndexOptions(fields=("english", "source"), id_field="doc_id", extract_field=lambda n: F.when(F.col("lang") == "en", F.col("text")) if n == "english" else F.col(n))
PARTS = IndexOptions(fields=("p_name", "p_brand", "p_type"), id_field="p_partkey", store_fields=("p_size", "p_retailprice"))
PART = Q.Corpus("part", "p_partkey", (("p_name", "p_name"), ("p_brand", "p_brand"), ("p_type", "p_type")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, options: IndexOptions = DOCUMENTS) -> SearchIndex:
    return SearchIndex.from_dataframe(table(spark, sf_dir, "documents"), options)


def parts(spark: SparkSession, sf_dir: str, options: IndexOptions = PARTS) -> SearchIndex:
    return SearchIndex.from_dataframe(table(spark, sf_dir, "part"), options)


def add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def scored(df: DataFrame, ident: str = "doc_id", *more: Any) -> DataFrame:
    return df.select(F.col("id").alias(ident), *more, F.round("score", 6).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for a query of several words, prefixes and near words counting."""
    return scored(documents(spark, sf_dir).search("there thing", limit=10, prefix=True, fuzzy=0.2))


# The tables of an index.

add(
    "tokenize_default",
    lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(T.tokenize(F.col("text"))).alias("pos", "token")),
    f"SELECT doc_id, CAST(generate_subscripts(tk, 1) - 1 AS INTEGER) AS pos, unnest(tk) AS token FROM (SELECT doc_id, {Q.tokens('text')} AS tk FROM documents WHERE text IS NOT NULL)",
)
add("term_freqs", lambda s, d: documents(s, d).tables.bare.select(F.col("doc_ord").alias("doc_id"), "term", "tf"), f"WITH {TEXT.base()} SELECT id AS doc_id, term, CAST(tf AS INTEGER) AS tf FROM po")
add("field_lengths", lambda s, d: documents(s, d, TWO_FIELDS).tables.lengths.select(F.col("doc_ord").alias("doc_id"), "field_id", "len"), f"WITH {TEXT_SOURCE.base()} SELECT id AS doc_id, f AS field_id, CAST(dl AS INTEGER) AS len FROM fl")
add("doc_freqs", lambda s, d: documents(s, d, TWO_FIELDS).tables.terms.select("term", "field_id", "df"), f"WITH {TEXT_SOURCE.base()} SELECT term, f AS field_id, CAST(df AS BIGINT) AS df FROM dd")
add("vocabulary_order", lambda s, d: parts(s, d).dictionary().agg(F.collect_list("term").alias("t")).select(F.posexplode("t").alias("pos", "term")), f"WITH {PART.base()} SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS pos, term FROM (SELECT DISTINCT term FROM po)")
add("vocabulary", lambda s, d: documents(s, d).dictionary().select("term"), f"WITH {TEXT.base()} SELECT DISTINCT term FROM po")


def _averages(spark: SparkSession, index: SearchIndex) -> DataFrame:
    return spark.createDataFrame([(i, a) for i, a in enumerate(index.tables.averages)], "field_id int, avg_len double").withColumn("avg_len", F.round("avg_len", 6))


add("avg_field_length", lambda s, d: _averages(s, documents(s, d, TWO_FIELDS)), f"WITH {TEXT_SOURCE.base()} SELECT f AS field_id, round(a, 6) AS avg_len FROM st")
add(
    "avg_field_length_nulls",
    lambda s, d: _averages(s, documents(s, d, GAPS)),
    # A document counts towards the divisor of all later ones, whether it has the field or not.
    f"""WITH k AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, CASE WHEN lang = 'en' THEN {Q.tokens('text')} END AS tk, {Q.tokens('source')} AS src FROM documents),
 l AS (SELECT 0 AS f, n, len(list_distinct(tk))::double AS dl FROM k WHERE tk IS NOT NULL UNION ALL SELECT 1, n, len(list_distinct(src))::double FROM k WHERE src IS NOT NULL),
 w AS (SELECT f, n, dl, coalesce(sum(CASE WHEN n > 1 THEN ln((n - 1) / n::double) ELSE 0 END) OVER (PARTITION BY f ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM l)
SELECT f AS field_id, round(sum(dl / n * exp(later))::float::double, 6) AS avg_len FROM w GROUP BY f""",
)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents(spark, sf_dir, TWO_FIELDS)
    return index.dictionary().agg(F.count("*").alias("terms")).select("terms", F.lit(index.document_count).cast("long").alias("documents"), F.lit(len(index.options.fields)).alias("fields"))


add("index_meta", _counts, f"WITH {TEXT_SOURCE.base()} SELECT count(DISTINCT term) AS terms, (SELECT count(*) FROM documents) AS documents, 2 AS fields FROM po")
add("index_stats", lambda s, d: documents(s, d).stats(), f"WITH {TEXT.base()} SELECT 'documents' AS component, count(*) AS rows FROM documents UNION ALL SELECT 'postings', count(*) FROM po UNION ALL SELECT 'terms', count(*) FROM dd UNION ALL SELECT 'lengths', count(*) FROM documents")
add("index_faults", lambda s, d: documents(s, d).faults(), "SELECT '' AS fault, 0::bigint AS n WHERE false")
add("duplicate_ids", lambda s, d: SearchIndex.duplicate_ids(table(s, d, "events"), "user_id"), "SELECT user_id, count(*) AS count FROM events GROUP BY user_id HAVING count(*) > 1")

# Searches: (query, options of the call), and the same for SQL.

_NESTED = Combination(["the", Combination(["thing", "thble"], combine_with=OR)], combine_with=AND)
_CASCADE = Combination(["the", Combination(["thing thble"], combine_with=AND), "ering"], combine_with=AND_NOT)
SEARCHES: dict[str, tuple[Any, dict[str, Any], Q.Words | Q.Nested]] = {
    "search_exact": ("thing", {}, Q.Words(("thing",))),
    "search_or": ("the thing, Ering", {}, Q.Words(("the", "thing", "ering"))),
    "search_and": ("the thing", {"combine_with": AND}, Q.Words(("the", "thing"), "and")),
    "search_and_gated": ("the thing thble", {"combine_with": AND}, Q.Words(("the", "thing", "thble"), "and")),
    "search_and_not": ("the thing thble", {"combine_with": AND_NOT}, Q.Words(("the", "thing", "thble"), "and_not")),
    "search_prefix": ("thin", {"prefix": True}, Q.Words(("thin",), prefix=True)),
    "search_prefix_last": ("the thi", {"prefix": lambda t, i, ts: i == len(ts) - 1}, Q.Words(("the", "thi"), prefix=(False, True))),
    "search_fuzzy": ("theres", {"fuzzy": 0.3}, Q.Words(("theres",), distance=2)),
    "search_fuzzy_absolute": ("ther eringg", {"fuzzy": 1}, Q.Words(("ther", "eringg"), distance=1)),
    "search_fuzzy_capped": ("therened", {"fuzzy": 0.9, "max_fuzzy": 2}, Q.Words(("therened",), distance=2)),
    "search_fuzzy_function": ("there eringg", {"fuzzy": lambda t, i, ts: i == 1 and 0.2}, Q.Words(("there", "eringg"), distance=(0, 1))),
    "search_prefix_fuzzy": ("there their", {"prefix": True, "fuzzy": 0.2}, Q.Words(("there", "their"), prefix=True, distance=1)),
    "search_weights": ("there their", {"prefix": True, "fuzzy": 0.2, "weights": {"fuzzy": 0.2, "prefix": 0.8}}, Q.Words(("there", "their"), prefix=True, distance=1, weights=(0.8, 0.2))),
    "search_bm25_params": ("the thing", {"bm25": BM25(1.5, 0.5, 0.1)}, Q.Words(("the", "thing"), bm25=(1.5, 0.5, 0.1))),
    "search_boost_term": ("the thing", {"boost_term": lambda t, i, ts: 1.0 + i}, Q.Words(("the", "thing"), term_boost=(1.0, 2.0))),
    "search_duplicate_terms": ("thing thing the", {}, Q.Words(("thing", "thing", "the"))),
    "search_nested_and_or": (_NESTED, {}, Q.Nested((Q.Words(("the",)), Q.Nested((Q.Words(("thing",)), Q.Words(("thble",))), "or")), "and")),
    "search_nested_and_not_cascade": (_CASCADE, {}, Q.Nested((Q.Words(("the",)), Q.Nested((Q.Words(("thing", "thble"), "and"),), "and"), Q.Words(("ering",))), "and_not")),
    "search_topk": ("the thing", {"limit": 10}, Q.Words(("the", "thing"))),
}


def _search(query: Any, options: dict[str, Any]) -> Query:
    return lambda s, d: scored(documents(s, d).search(query, **options))


for _name, (_query, _options, _words) in SEARCHES.items():
    add(_name, _search(_query, _options), Q.search(TEXT, _words, limit="ORDER BY score DESC, id LIMIT 10" if "limit" in _options else ""))

add("search_empty", _search("...", {}), "SELECT 0::bigint AS doc_id, 0::double AS score WHERE false")
add("search_fields", lambda s, d: scored(documents(s, d, TWO_FIELDS).search("the src3", fields=["source"])), Q.search(TEXT_SOURCE, Q.Words(("the", "src3"), fields=("source",))))
add("search_field_boost", lambda s, d: scored(documents(s, d, TWO_FIELDS).search("the src3", boost={"source": 2.5, "text": 0})), Q.search(TEXT_SOURCE, Q.Words(("the", "src3"), boost={"source": 2.5})))
add("search_multi_field", lambda s, d: scored(documents(s, d, TWO_FIELDS).search("thing src1", prefix=True)), Q.search(TEXT_SOURCE, Q.Words(("thing", "src1"), prefix=True)))
add(
    "search_boost_document",
    lambda s, d: scored(documents(s, d).search("the thing", boost_document=lambda i, term, stored: F.when(stored["lang"] == "en", F.when(term == "thing", 2.0).otherwise(1.5)))),
    Q.search(TEXT, Q.Words(("the", "thing"), doc_boost="(SELECT CASE WHEN t.lang = 'en' THEN CASE WHEN po.term = 'thing' THEN 2.0 ELSE 1.5 END END::double FROM documents t WHERE t.doc_id = po.id)")),
)
add("search_filter_stored", lambda s, d: scored(documents(s, d).search("the thing", filter="lang = 'en' AND score > 1 AND size(query_terms) = 2"), "doc_id", "lang", "source"), Q.search(TEXT, Q.Words(("the", "thing")), "id AS doc_id, lang, source", "JOIN documents ON doc_id = id", "WHERE lang = 'en' AND score > 1 AND words = 2"))
add("search_wildcard", lambda s, d: scored(documents(s, d).search(WILDCARD)), "SELECT doc_id, 1.0::double AS score FROM documents")
add("search_wildcard_filter", lambda s, d: scored(documents(s, d).search(WILDCARD, filter=F.col("lang") == "fr")), "SELECT doc_id, 1.0::double AS score FROM documents WHERE lang = 'fr'")
add("search_wildcard_boost", lambda s, d: scored(documents(s, d).search(WILDCARD, boost_document=lambda i, term, stored: F.when(stored["lang"] == "de", stored["n_chars"].cast("double")))), "SELECT doc_id, CASE WHEN lang = 'de' THEN n_chars::double ELSE 0::double END AS score FROM documents")
add("search_wildcard_and_not", lambda s, d: scored(documents(s, d).search(Combination([WILDCARD, "the"], combine_with=AND_NOT))), f"WITH {TEXT.base()} SELECT doc_id, 1.0::double AS score FROM documents WHERE doc_id NOT IN (SELECT id FROM po WHERE term = 'the')")
add(
    "search_null_fields",
    lambda s, d: scored(documents(s, d, GAPS).search("src3", fields=["source"])),
    Q.search(Q.Corpus("documents", "doc_id", (("english", "CASE WHEN lang = 'en' THEN text END"), ("source", "source"))), Q.Words(("src3",), fields=("source",))),
)

# What a search says of its matches.

add(
    "match_info",
    lambda s, d: documents(s, d, TWO_FIELDS).search("there src1", prefix=True, fuzzy=0.2).select(F.col("id").alias("doc_id"), F.explode("match").alias("term", "fields")).select("doc_id", "term", F.explode("fields").alias("field")),
    Q.matches(TEXT_SOURCE, Q.Words(("there", "src1"), prefix=True, distance=1)),
)
add(
    "query_terms",
    lambda s, d: documents(s, d).search("the thing thble").select(F.col("id").alias("doc_id"), F.array_join("query_terms", " ").alias("words")),
    f"WITH {TEXT.base()} SELECT id AS doc_id, string_agg(term, ' ' ORDER BY CASE term WHEN 'the' THEN 0 WHEN 'thing' THEN 1 ELSE 2 END) AS words FROM po WHERE term IN ('the', 'thing', 'thble') GROUP BY id",
)
add("has_ids", lambda s, d: documents(s, d).lookup(table(s, d, "labels").select("doc_id")).select(F.col("id").alias("doc_id"), "found"), "SELECT doc_id, doc_id IN (SELECT doc_id FROM documents) AS found FROM labels")
add("stored_fields_lookup", lambda s, d: documents(s, d).lookup(table(s, d, "labels").select("doc_id")).select(F.col("id").alias("doc_id"), "stored.*"), "SELECT l.doc_id, lang, source, n_chars FROM labels l LEFT JOIN documents USING (doc_id)")

# Suggestions.

add("auto_suggest", lambda s, d: parts(s, d).auto_suggest("red wi").select("suggestion", F.round("score", 6).alias("score")), Q.suggest(PART, Q.Words(("red", "wi"), prefix=(False, True))))
add("auto_suggest_fuzzy", lambda s, d: parts(s, d).auto_suggest("rad wi", fuzzy=0.3).select("suggestion", F.round("score", 6).alias("score")), Q.suggest(PART, Q.Words(("rad", "wi"), prefix=(False, True), distance=1)))
add("auto_suggest_filter", lambda s, d: parts(s, d).auto_suggest("brand promo s", filter="p_size > 20").select("suggestion", F.round("score", 6).alias("score")), Q.suggest(PART, Q.Words(("brand", "promo", "s"), prefix=(False, False, True)), "p_size > 20"))

# Analyzers.


def _dashes(text: Column, field: str = "") -> Column:
    return F.split(text, "[^a-z]+", -1)


add("custom_tokenize", lambda s, d: scored(documents(s, d, IndexOptions(fields=("text",), id_field="doc_id", tokenize=_dashes)).search("er le")), Q.search(Q.Corpus("documents", "doc_id", (("text", "text"),), lambda e: f"string_split_regex({e}, '[^a-z]+')"), Q.Words(("er", "le"))))
add(
    "camel_case_tokenize",
    lambda s, d: table(s, d, "part").select("p_partkey", F.explode(T.camel_case_tokenize(F.concat(F.col("p_name"), F.initcap("p_type")))).alias("token")).groupBy("token").agg(F.count("*").alias("n")),
    f"WITH w AS (SELECT {Q.tokens('p_name || upper(p_type[1]) || lower(p_type[2:])')} AS ws FROM part), t AS (SELECT unnest(ws) AS token FROM w UNION ALL SELECT p FROM (SELECT ws, unnest(flatten(list_transform(ws, lambda x: string_split(regexp_replace(x, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'), ' ')))) AS p FROM w) WHERE NOT list_contains(ws, p)) SELECT token, count(*) AS n FROM t GROUP BY token",
)
STOPS = IndexOptions(fields=("text",), id_field="doc_id", process_term=T.stop_words(["the", "of"]))
DOUBLES = IndexOptions(fields=("p_name",), id_field="p_partkey", process_term=lambda t: F.array(F.lower(t), F.concat(F.lit("x"), F.lower(t))), term_arrays=True)
CAMELS = IndexOptions(fields=("name",), id_field="p_partkey", tokenize=T.camel_case_tokenize, extract_field=lambda n: F.concat(F.col("p_name"), F.initcap("p_type")) if n == "name" else F.col(n))
_DOUBLED = Q.Corpus("(SELECT p_partkey, p_name FROM part)", "p_partkey", (("p_name", "p_name"),), term="unnest([lower(raw), 'x' || lower(raw)])")


def _camels(expr: str) -> str:
    """Words, then their parts at capitals that aren't words themselves; words hold no blanks."""
    ws = Q.tokens(expr)
    return f"({ws} || list_filter(flatten(list_transform({ws}, lambda x: string_split(regexp_replace(x, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'), ' '))), lambda y: NOT list_contains({ws}, y)))"


add("process_term_stopwords", lambda s, d: scored(documents(s, d, STOPS).search("the thing of")), Q.search(Q.Corpus("documents", "doc_id", (("text", "text"),), term="CASE WHEN lower(raw) NOT IN ('the', 'of') THEN lower(raw) END"), Q.Words(("thing",))))
add("process_term_array", lambda s, d: scored(parts(s, d, DOUBLES).search("xred", process_term=lambda t: t), "p_partkey"), Q.search(_DOUBLED, Q.Words(("xred",)), "id AS p_partkey"))
# By the index's own functions each word of the query gives two terms, or is cut at its capitals.
add("search_process_term_array_query", lambda s, d: scored(parts(s, d, DOUBLES).search("red ring"), "p_partkey"), Q.search(_DOUBLED, Q.Words(("red", "xred", "ring", "xring")), "id AS p_partkey"))
add("search_camel_case", lambda s, d: scored(parts(s, d, CAMELS).search("ringPromo Small"), "p_partkey"), Q.search(Q.Corpus("part", "p_partkey", (("name", "p_name || upper(p_type[1]) || lower(p_type[2:])"),), _camels), Q.Words(("ringpromo", "small", "ring", "promo")), "id AS p_partkey"))
add(
    "extract_field_json",
    lambda s, d: scored(SearchIndex.from_dataframe(table(s, d, "events"), IndexOptions(fields=("k", "event_type"), id_field="event_id", extract_field=lambda n: F.get_json_object("props", "$.k") if n == "k" else F.col(n))).search("42 click", combine_with=AND), "event_id"),
    Q.search(Q.Corpus("events", "event_id", (("k", "props->>'$.k'"), ("event_type", "event_type"))), Q.Words(("42", "click"), "and"), "id AS event_id"),
)
add(
    "stringify_numeric",
    lambda s, d: scored(parts(s, d, IndexOptions(fields=("p_size", "p_name"), id_field="p_partkey")).search("7 ring"), "p_partkey"),
    Q.search(Q.Corpus("part", "p_partkey", (("p_size", "p_size::varchar"), ("p_name", "p_name"))), Q.Words(("7", "ring")), "id AS p_partkey"),
)

# Other tables.

add("search_parts", lambda s, d: scored(parts(s, d).search("red promo 17", boost={"p_type": 2}), "p_partkey"), Q.search(PART, Q.Words(("red", "promo", "17"), boost={"p_type": 2.0}), "id AS p_partkey"))
add(
    "search_pages",
    lambda s, d: scored(SearchIndex.from_dataframe(table(s, d, "pages"), IndexOptions(fields=("url", "html"), id_field="page_id")).search("example the", combine_with=AND, fields=["url", "html"], boost={"url": 3}), "page_id"),
    Q.search(Q.Corpus("pages", "page_id", (("url", "url"), ("html", "html"))), Q.Words(("example", "the"), "and", boost={"url": 3.0}), "id AS page_id"),
)

def turns(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """Role and text of every distinct row; rows of one turn of a conversation are numbered."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").distinct()
    number = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()))
    key = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("conv_id", "turn")], number.cast("string"))
    rows = said.select(key.alias("key"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return SearchIndex.from_dataframe(rows, IndexOptions(fields=("role", "text"), id_field="key"))


_TURNS = """(SELECT coalesce(conv_id::varchar, 'null') || '-' || coalesce(turn::varchar, 'null') || '-' || row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS key,
 coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations))"""
add("search_conversations", lambda s, d: scored(turns(s, d).search("user the der"), "key"), Q.search(Q.Corpus(_TURNS, "key", (("role", "role"), ("text", "text"))), Q.Words(("user", "the", "der")), "id AS key"))

# Ways in and out; each gives what the index itself gives.


def _saved(codec: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{work_folder(spark)}/index-{uuid.uuid4().hex}"
        documents(spark, sf_dir).save(path, codec)
        return scored(SearchIndex.load(spark, path).search("there thing", prefix=True))

    return run


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot in parts, its text being as long as the index is large; read by what it says itself."""
    path = f"{work_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    parts(spark, sf_dir).save_json(path)
    return scored(SearchIndex.load_json(spark, path).search("red wi", prefix=True), "p_partkey")


def _json_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot in parts, read with the options of its index."""
    path = f"{work_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    documents(spark, sf_dir).save_json(path)
    return scored(SearchIndex.load_json(spark, path, DOCUMENTS).search("there thing", prefix=True))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.ingest import index_stream

    where = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
    return scored(index_stream(stream, DOCUMENTS, f"{where}/table", f"{where}/checkpoint").search("there thing", prefix=True))


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    builder = IndexBuilder(spark, DOCUMENTS).add_all(docs.where(english)).add_all(docs.where(~english))
    return scored(builder.freeze().search("there thing", prefix=True))


NATIONS = IndexOptions(fields=("n_name",), id_field="n_nationkey", store_fields=("n_regionkey",))
NATION = Q.Corpus("nation", "n_nationkey", (("n_name", "n_name"),))
_NATIONS = "n_nationkey long, n_name string, n_regionkey long"


def _rows(spark: SparkSession, sf_dir: str) -> list[dict[str, Any]]:
    return [r.asDict() for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey")).collect()]


def _added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents added one by one."""
    builder = IndexBuilder(spark, NATIONS, estimated_document_count=25)
    for row in _rows(spark, sf_dir):
        builder.add(row, _NATIONS)
    return scored(builder.freeze().search("nation 1", prefix=True), "n_nationkey", "n_regionkey")


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents added in chunks."""
    index = create_builder(spark, NATIONS).add_all_in_chunks(_rows(spark, sf_dir), 7, _NATIONS).freeze()
    return scored(index.search("nation 1", prefix=True), "n_nationkey", "n_regionkey").withColumn("documents", F.lit(index.document_count).cast("long"))


def _lengths_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths looked up by id, one that isn't there among them."""
    index = build_from_documents(table(spark, sf_dir, "region").select("r_regionkey", F.concat_ws(" ", "r_name", "r_name", F.lit("of the world")).alias("t")), IndexOptions(fields=("t",), id_field="r_regionkey"))
    ids = [r["r_regionkey"] for r in table(spark, sf_dir, "region").select("r_regionkey").collect()] + [1_000_000]
    return spark.createDataFrame([(i, index.has(i), index.field_length(i, "t")) for i in ids], "r_regionkey long, found boolean, len int")


def _often(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies beyond what postings hold."""
    texts = table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.repeat(F.concat("r_name", F.lit(" ")), 70_000), F.lit("once")).alias("t"))
    return SearchIndex.from_dataframe(texts, IndexOptions(fields=("t",), id_field="r_regionkey")).tables.postings.select(F.col("doc_ord").cast("long").alias("r_regionkey"), "term", "tf")


_NATION = "id AS n_nationkey, n_regionkey::bigint AS n_regionkey"
add("builder_add", _added, Q.search(NATION, Q.Words(("nation", "1"), prefix=True), _NATION, "JOIN nation ON n_nationkey = id"))
add("builder_chunks", _chunked, Q.search(NATION, Q.Words(("nation", "1"), prefix=True), f"{_NATION}, (SELECT count(*) FROM nation) AS documents", "JOIN nation ON n_nationkey = id"))
add("field_length_lookup", _lengths_of, f"SELECT r_regionkey::bigint AS r_regionkey, true AS found, len(list_distinct({Q.tokens("r_name || ' ' || r_name || ' of the world'")}))::integer AS len FROM region UNION ALL SELECT 1000000, false, 0")
_OFTEN = Q.Corpus("region", "r_regionkey", (("t", "repeat(r_name || ' ', 70000) || 'once'"),))
add("clamped_frequencies", _often, f"WITH {_OFTEN.base()} SELECT id::bigint AS r_regionkey, term, CAST(tf AS INTEGER) AS tf FROM po")
_SAME = Q.search(TEXT, Q.Words(("there", "thing"), prefix=True))
add("roundtrip_parquet", _saved("zstd"), _SAME)
add("roundtrip_parquet_zlib", _saved("zlib"), _SAME)
add("roundtrip_parquet_raw", _saved("raw"), _SAME)
add("roundtrip_json", _json, Q.search(PART, Q.Words(("red", "wi"), prefix=True), "id AS p_partkey"))
add("roundtrip_json_parts", _json_parts, _SAME)
add("stream_ingest", _streamed, _SAME)
add("builder", _built, _SAME)

# Many queries at once: each benchmark item is one.

_MANY = f"""WITH {TEXT.base()},
 q AS (SELECT item_id AS query_id, lower(raw) AS term, count(*) AS times FROM (SELECT item_id, unnest({Q.tokens('text')}) AS raw FROM benchmark) WHERE raw <> '' GROUP BY ALL),
 r AS (SELECT query_id, id AS doc_id, count(*) * sum(times * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (0.5::double + tf * 2.2::double / (tf + 1.2::double * (0.3::double + 0.7::double / a * dl)))) AS score
       FROM q JOIN po USING (term) JOIN dd USING (f, term) JOIN fl USING (id, f) JOIN st USING (f), nn GROUP BY query_id, id)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


add("search_many", lambda s, d: documents(s, d).search_many(_items(s, d)).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score")), f"{_MANY} SELECT query_id, doc_id, round(score, 6) AS score FROM r")
# Equal documents tie, and the lower id goes first; the SQL adds up in another order, so it rounds before it ranks.
add(
    "search_many_topk",
    lambda s, d: documents(s, d).search_many(_items(s, d), limit=5).select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score")),
    f"{_MANY} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) WHERE rank <= 5",
)
# Each kind of event is a query, with letters changed; terms of texts are near it.
add(
    "search_many_fuzzy",
    lambda s, d: parts(s, d).search_many(table(s, d, "part").select(F.col("p_brand").alias("b")).distinct().select(F.col("b").alias("query_id"), F.concat(F.lower("b"), F.lit(" standrd")).alias("query")), fuzzy=0.3).select("query_id", F.col("id").alias("p_partkey"), F.round("score", 6).alias("score")),
    f"""WITH {PART.base()},
 q AS (SELECT DISTINCT query_id, lower(raw) AS q FROM (SELECT query_id, unnest({Q.tokens("lower(query_id) || ' standrd'")}) AS raw FROM (SELECT DISTINCT p_brand AS query_id FROM part)) WHERE raw <> ''),
 e AS (SELECT q, t, CASE WHEN t = q THEN 1.0::double ELSE 0.45::double * length(t) / (length(t) + levenshtein(t, q)) END AS tw FROM (SELECT DISTINCT q FROM q), (SELECT DISTINCT term AS t FROM po) WHERE t = q OR levenshtein(t, q) <= least(6, floor(length(q) * 0.3::double + 0.5)))
SELECT query_id, id AS p_partkey, round(count(DISTINCT q) * sum(tw * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (0.5::double + tf * 2.2::double / (tf + 1.2::double * (0.3::double + 0.7::double / a * dl)))), 6) AS score
FROM q JOIN e USING (q) JOIN po ON po.term = e.t JOIN dd USING (f, term) JOIN fl USING (id, f) JOIN st USING (f), nn GROUP BY query_id, id""",
)
