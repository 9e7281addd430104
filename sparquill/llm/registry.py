"""The corpus operators as queries over the test tables, with the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, licenses, line_dedup, ngram_join, pii, quality, sharding, url_rules


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal_conversations(_read(spark, sf_dir, "conversations"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.tag(_read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs, count_col="n_dropped")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    # Its SQL has one limit of the word distance for every length.
    return quality.judge(docs, falling=False).where("keep").select("doc_id", "n_words", F.round("char_distance", 5).alias("char_distance"), F.round("word_distance", 5).alias("word_distance"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_url_filters, op3_pii, op4_line_dedup, op5_license_scans, op6_decontamination, op7_bpe, op8_sharding, op9_quality_rules, op10_ngram_jaccard_join, pipeline)
}

_CHAT = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, count(*) AS n, list(role || chr(31) || text ORDER BY turn NULLS FIRST, role, text) AS said,
        string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered FROM t GROUP BY conv_id),
 p AS (SELECT DISTINCT hash(said[1:k]) AS h, said[1:k] AS said FROM (SELECT said, unnest(range(1, n)) AS k FROM c)),
 m AS (SELECT c.* FROM c LEFT JOIN p ON hash(c.said) = p.h AND c.said = p.said WHERE p.h IS NULL)
SELECT min(conv_id) AS conv_id, CAST(n AS INTEGER) AS n_turns, arg_min(rendered, conv_id) AS rendered FROM m GROUP BY said, n
"""

_URLS = r"""
WITH RECURSIVE u AS (SELECT page_id, url, lower(coalesce(url, '')) AS u FROM pages),
 e AS (SELECT *, regexp_extract(u, '^([a-z][a-z0-9+.-]*)://', 1) AS scheme, regexp_extract(u, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) AS host,
         regexp_extract(u, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '\?([^#]*)', 1) AS query FROM u),
 t AS (SELECT page_id, url, list_sort(list_distinct(list_filter([CASE WHEN scheme <> '' THEN 's:' || scheme END, CASE WHEN host <> '' THEN 'host:' || host END, CASE WHEN contains(u, '#') THEN 'fragment' END]
         || list_transform(list_filter(string_split_regex(host, '[^\p{L}\p{N}_]+'), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+')), lambda x: 'h:' || x)
         || list_transform(list_filter(string_split_regex(path, '[^\p{L}\p{N}_]+'), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+')), lambda x: 'p:' || x)
         || list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'q:' || regexp_replace(x, '=.*', '')), lambda x: x IS NOT NULL))) AS tokens FROM e),
 b AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
 l AS MATERIALIZED (SELECT row_number() OVER () AS r, tokens, bad FROM t JOIN b ON page_id = doc_id),
 n AS (SELECT count(*)::double AS n, sum(bad)::double AS nb FROM l),
 y AS (SELECT r, bad, unnest(tokens) AS a FROM l),
 x AS MATERIALIZED (SELECT y.* FROM y JOIN (SELECT a FROM y GROUP BY a HAVING sum(bad) >= (SELECT greatest(ceil(0.002::double * n), 10) FROM n)) USING (a)),
 s AS (SELECT r, bad, [a] AS k, a AS top FROM x UNION ALL SELECT s.r, s.bad, list_append(s.k, x.a), x.a FROM s JOIN x ON x.r = s.r AND x.a > s.top),
 c AS (SELECT k, count(*)::double AS f, sum(bad)::double AS fb FROM s GROUP BY k),
 rules AS MATERIALIZED (SELECT k, fb / f AS conf FROM c, n WHERE fb >= greatest(ceil(0.002::double * n), 10) AND fb / f >= 0.35 AND fb / f - nb / n >= 2.0::double * sqrt(nb / n * (1 - nb / n) / f)),
 kept AS (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules q WHERE len(q.k) < len(r.k) AND q.conf >= r.conf AND list_has_all(r.k, q.k))),
 m AS (SELECT tokens, count(*) AS n_rules, max(conf) AS confidence FROM (SELECT DISTINCT tokens FROM t) JOIN kept ON list_has_all(tokens, k) GROUP BY tokens)
SELECT page_id, url, CAST(coalesce(n_rules, 0) AS INTEGER) AS n_rules, round(confidence, 6) AS confidence, n_rules IS NOT NULL AS blocked FROM t LEFT JOIN m USING (tokens)
"""

_LINES = """
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
 b AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
 r AS (SELECT *, bare = '' OR row_number() OVER (PARTITION BY bare ORDER BY doc_id NULLS LAST, pos) = 1 AS keep FROM b),
 d AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (keep) AS text, CAST(count(*) FILTER (NOT keep) AS INTEGER) AS n_dropped, coalesce(max(bare) FILTER (keep), '') AS best FROM r GROUP BY doc_id)
SELECT doc_id, text, n_dropped FROM d WHERE n_dropped = 0 OR best <> ''
UNION ALL SELECT doc_id, text, 0 FROM documents WHERE text IS NULL
"""

_QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, text, length(text) AS nc, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents WHERE text IS NOT NULL),
 ch AS (SELECT doc_id, lang, unnest([nc - length(regexp_replace(text, '\p{Ll}', '', 'g')), nc - length(regexp_replace(text, '\p{Lu}', '', 'g')),
          nc - length(regexp_replace(text, '[\p{Lt}\p{Lm}\p{Lo}]', '', 'g')), nc - length(regexp_replace(text, '\p{Nd}', '', 'g')), nc - length(regexp_replace(text, '[ \t\r\n]', '', 'g')),
          nc - length(regexp_replace(text, '[.,;:!?''"()-]', '', 'g')), length(regexp_replace(text, '[\p{L}\p{Nd} \t\r\n.,;:!?''"()-]', '', 'g'))]) AS n, unnest(range(7)) AS item, nc FROM d),
 cr AS (SELECT lang, item, sum(n)::double AS n FROM ch GROUP BY ALL),
 ct AS (SELECT lang, sum(n) AS t FROM cr GROUP BY lang),
 cj AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS cd
        FROM (SELECT doc_id, ch.n / nc::double AS p, cr.n / t AS q FROM ch JOIN cr USING (lang, item) JOIN ct USING (lang) WHERE nc >= 300) GROUP BY doc_id),
 w AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(ws) AS word FROM d) GROUP BY ALL),
 top AS (SELECT lang, word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM w) WHERE r <= 50),
 wt AS (SELECT lang, sum(n)::double AS t FROM w GROUP BY lang),
 ref AS (SELECT lang, word, n / t AS q FROM top JOIN wt USING (lang) UNION ALL SELECT lang, '', 1 - sum(n) / any_value(t) FROM top JOIN wt USING (lang) GROUP BY lang),
 own AS (SELECT doc_id, coalesce(top.word, '') AS word, count(*) AS n FROM (SELECT doc_id, lang, unnest(ws) AS word FROM d) x LEFT JOIN top USING (lang, word) GROUP BY ALL),
 wj AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS wd
        FROM (SELECT d.doc_id, coalesce(own.n, 0) / len(ws)::double AS p, q FROM d JOIN ref USING (lang) LEFT JOIN own ON own.doc_id = d.doc_id AND own.word = ref.word WHERE len(ws) >= 80) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS INTEGER) AS n_words, round(cd, 5) AS char_distance, round(wd, 5) AS word_distance
FROM d LEFT JOIN cj USING (doc_id) LEFT JOIN wj USING (doc_id) WHERE len(ws) > 0 AND coalesce(cd <= 0.22, true) AND coalesce(wd <= 0.38, true)
"""

_JOIN = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
 w AS (SELECT r, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM d),
 g AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w WHERE len(w) > 0),
 z AS (SELECT r, count(*) AS n FROM g GROUP BY r),
 p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
 e AS MATERIALIZED (SELECT unnest([a, b]) AS a, unnest([b, a]) AS b FROM p JOIN z x ON x.r = a JOIN z y ON y.r = b WHERE c >= 0.5 * (x.n + y.n - c)),
 t AS (SELECT r, r AS other FROM d UNION SELECT t.r, e.b FROM t JOIN e ON e.a = t.other)
SELECT d.doc_id, min(o.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.a = d.r) AS n_links FROM d JOIN t ON t.r = d.r JOIN d o ON o.r = t.other GROUP BY d.r, d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_chat_formatting": _CHAT, "op2_url_filters": _URLS, "op4_line_dedup": _LINES, "op9_quality_rules": _QUALITY, "op10_ngram_jaccard_join": _JOIN}
