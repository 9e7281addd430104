import itertools
import time
from collections import Counter

from rows import with_extras
from sparquill.llm import url_rules as U

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels, support, confidence, sigma, least):
    """All itemsets by counting, then the rules and their matches."""
    bad = {i: any(q == 0 or t == 1 for j, q, t in labels if j == i) for i in {x[0] for x in labels} - {None}}
    sets = [(frozenset(t), bad[i]) for i, t in rows if i in bad]
    if len(sets) < least:
        return {}
    base = sum(b for _, b in sets) / len(sets)
    n, k = Counter(), Counter()
    for s, b in sets:
        for size in range(1, len(s) + 1):
            for c in map(frozenset, itertools.combinations(s, size)):
                n[c] += 1
                k[c] += b
    rules = {c: k[c] / n[c] for c in n if k[c] >= max(least, support * len(sets)) and k[c] / n[c] >= confidence and k[c] / n[c] - base >= sigma * (base * (1 - base) / n[c]) ** 0.5}
    return {c: p for c, p in rules.items() if not any(d < c and q >= p for d, q in rules.items())}


def tables(spark):
    urls = [(i, f"http://site{i % 7}.example.com/{'shop' if i % 3 else 'blog'}/page{i % 5}/{i}?ref={i}") for i in range(120)]
    urls += [(500, None), (501, ""), (502, "no url at all"), (None, "http://site1.example.com/shop/page1"), (3, urls[3][1])]
    labels = [(i, int(not (i % 7 == 1 and i % 3)), int(i % 35 == 0)) for i in range(0, 120, 2)] + [(4, None, None), (None, 0, 1), (6, 0, 0)]
    return spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, LABELS), urls, labels


def test_against_brute_force(spark):
    pages, labels, urls, marks = tables(spark)
    tokens = [(r["page_id"], r["t"]) for r in pages.select("page_id", U.url_tokens(pages["url"]).alias("t")).collect()]
    o = {"min_support": 0.02, "min_confidence": 0.35, "min_sigma": 0.5, "min_count": 2}
    rules = brute(tokens, marks, o["min_support"], o["min_confidence"], o["min_sigma"], o["min_count"])
    assert max(map(len, rules)) > 1
    want = sorted((str(i), sum(set(t) >= c for c in rules), round(max([p for c, p in rules.items() if set(t) >= c], default=-1), 6)) for i, t in tokens)
    for p, x in ((pages, labels), (with_extras(pages), with_extras(labels))):
        out = U.filter_urls(p, x, **o).collect()
        assert sorted((str(r["page_id"]), r["n_rules"], -1 if r["confidence"] is None else r["confidence"]) for r in out) == want
        assert all(r["blocked"] == (r["n_rules"] > 0) for r in out) and any(r["blocked"] for r in out)


def test_empty_tables(spark):
    pages, labels, urls, _ = tables(spark)
    assert U.filter_urls(pages.limit(0), labels).count() == 0
    none = U.filter_urls(pages, labels.limit(0)).collect()
    assert len(none) == len(urls) and not any(r["blocked"] for r in none)


def test_nothing_is_bad(spark):
    pages, labels, urls, _ = tables(spark)
    good = labels.selectExpr("doc_id", "1 as quality", "0 as toxic")
    assert not any(r["blocked"] for r in U.filter_urls(pages, good).collect())


def test_tokens(spark):
    df = spark.createDataFrame([("HTTPS://A.Example.org/Dir/file2.html?q=1&z#top",)], "url string")
    assert set(df.select(U.url_tokens(df["url"]).alias("t")).first()["t"]) == {"s:https", "host:a.example.org", "h:a", "h:example", "h:org", "p:dir", "p:file2", "p:html", "q:q", "q:z", "fragment"}


def test_a_template_of_many_keys(spark):
    """Thirty tokens that always occur together are one item: 2 ** 30 item sets aren't mined, and no rule is lost."""
    keys = "&".join(f"k{i}=1" for i in range(30))
    urls = [(i, f"http://bad.example/{'x' if i % 2 else 'y'}?{keys}") for i in range(10)] + [(100 + i, f"http://good.example/{'x' if i % 3 else 'z'}/{i}") for i in range(40)]
    urls += [(200, "http://other.example/?k3=1&k4=2"), (201, "http://bad.example/")]
    labels = [(i, int(i >= 100), 0) for i, _ in urls if i < 200]
    began = time.time()
    out = {r["page_id"]: r["n_rules"] for r in U.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, LABELS), min_count=5).collect()}
    assert time.time() - began < 60
    # Each key, the host and its first word is a rule; of a path and one of these, none is any surer.
    assert all(out[i] == 32 + (i % 2 == 0) for i in range(10)) and out[200] == 2 and out[201] == 2 and out[100] == 0


def test_rules_of_more_than_four_tokens(spark):
    """A rule that needs five tokens at once is found."""
    urls, labels = [], []
    for i in range(64):
        path = "/".join("abcdef"[j] if i >> j & 1 else f"n{i}" for j in range(6))
        urls.append((i, f"http://h.example/{path}"))
        labels.append((i, int(i & 31 != 31), 0))
    pages, marks = spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, LABELS)
    tokens = [(r["page_id"], r["t"]) for r in pages.select("page_id", U.url_tokens(pages["url"]).alias("t")).collect()]
    o = {"min_support": 0.01, "min_confidence": 0.9, "min_sigma": 1.0, "min_count": 2}
    rules = brute(tokens, labels, 0.01, 0.9, 1.0, 2)
    assert max(map(len, rules)) == 5
    assert {r["page_id"]: r["n_rules"] for r in U.filter_urls(pages, marks, **o).collect()} == {i: sum(set(t) >= c for c in rules) for i, t in tokens}
