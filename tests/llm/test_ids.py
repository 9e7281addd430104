"""Ids of any type: operators give with text ids what they give with numbers."""

import pytest

from rows import awkward, with_extras
from sparquill.llm import bpe, licenses, line_dedup, pii, quality, sharding, url_rules

OPERATORS = {
    "pii": lambda d: pii.tag(d),
    "lines": lambda d: line_dedup.drop_repeated_lines(d).select("doc_id", "text"),
    "licences": lambda d: licenses.scan_licenses(d),
    "bpe": lambda d: bpe.encode(d),
    "sharding": lambda d: sharding.shard_documents(d, shards=3),
    "quality": lambda d: quality.judge(d, prefix="q_").select("doc_id", "q_n_words", "q_keep"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_text_ids(spark, name):
    rows = [*awkward(), (50, "mail a.b7@mail3.example.com, released under the MIT License"), (50, "mail a.b7@mail3.example.com, released under the MIT License")]
    numbers = OPERATORS[name](with_extras(spark.createDataFrame(rows, "doc_id long, text string")))
    texts = OPERATORS[name](with_extras(spark.createDataFrame([(None if i is None else str(i), t) for i, t in rows], "doc_id string, text string")))
    assert dict(texts.dtypes)["doc_id"] == "string"
    plain = lambda df: sorted(repr(tuple(str(x) if k == "doc_id" else x for k, x in r.asDict().items())) for r in df.collect())
    assert plain(numbers) == plain(texts) and plain(texts)


def test_text_ids_of_pages(spark):
    rows = [(f"p{i}", f"http://{'bad' if i % 2 else 'good'}.example/{i}") for i in range(40)]
    labels = spark.createDataFrame([(f"p{i}", 1 - i % 2, 0) for i in range(40)], "doc_id string, quality int, toxic int")
    out = url_rules.filter_urls(spark.createDataFrame(rows, "page_id string, url string"), labels, min_count=3)
    assert {r["page_id"] for r in out.where("blocked").collect()} == {f"p{i}" for i in range(1, 40, 2)}
