import math
import random
from collections import Counter

import pytest
import regex

from rows import awkward, letters, with_extras
from sparquill.llm import quality as Q

SCHEMA = "doc_id long, lang string, text string"
CLASS = [r"\p{Ll}", r"\p{Lu}", r"[\p{Lt}\p{Lm}\p{Lo}]", r"\p{Nd}", r"[ \t\r\n]", r"[.,;:!?'\"()-]"]


def chars(t):
    n = [len(regex.findall(c, t)) for c in CLASS]
    return [*n, len(t) - sum(n)]


def jsd(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    d = sum(a * math.log2(a / c) for a, c in zip(p, m, strict=True) if a) + sum(b * math.log2(b / c) for b, c in zip(q, m, strict=True) if b)
    return math.sqrt(max(0, d / 2))


def brute(rows):
    every, words = {}, {}
    for _, lang, t in rows:
        if t is not None:
            every[lang or ""] = [a + b for a, b in zip(every.get(lang or "", [0] * 7), chars(t), strict=True)]
            words.setdefault(lang or "", Counter()).update(regex.findall(r"\p{L}+", t.lower()))
    out = []
    for i, lang, t in rows:
        w = regex.findall(r"\p{L}+", (t or "").lower())
        top = sorted(words.get(lang or "", {}).items(), key=lambda x: (-x[1], x[0]))[: Q.COMMON_WORDS]
        names = [x for x, _ in top]
        c = Counter(x if x in names else "" for x in w)
        total = sum(words.get(lang or "", {}).values())
        by_char = jsd(chars(t), every[lang or ""]) if t and len(t) >= Q.MIN_CHARS else None
        by_word = jsd([c[x] for x in [*names, ""]], [n for _, n in top] + [total - sum(n for _, n in top)]) if len(w) >= Q.MIN_WORDS else None
        out.append((str(i), len(w), by_char, by_word, bool(w) and (by_char or 0) <= Q.MAX_CHAR_DISTANCE and (by_word or 0) <= Q.MAX_WORD_DISTANCE))
    return out


def corpus():
    r = random.Random(3)
    common = letters(r, 60).split()
    good = lambda n: " ".join(r.choice(common) if r.random() < 0.6 else letters(r, 1) for _ in range(n)).capitalize() + "."
    rows = [(i, r.choice(["en", "fr", None]), good(r.choice([r.randint(5, 70), 400]))) for i in range(90)]
    rows += [(100, "en", "### $$$ %%% " * 100), (101, "en", " ".join(str(r.random()) for _ in range(100))), (102, "fr", letters(r, 300)), (103, "xx", "alone"), (104, "en", (common[0] + " ") * 300)]
    return rows + [(i, "zz", t) for i, t in awkward()]


def test_against_brute_force(spark):
    rows = corpus()
    out = Q.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    have = [(str(r["doc_id"]), r["n_words"], r["char_distance"], r["word_distance"], r["keep"]) for r in out]
    order = lambda x: (x[0], x[1], x[2] or -1, x[3] or -1)
    for a, b in zip(sorted(have, key=order), sorted(brute(rows), key=order), strict=True):
        assert a[:2] == b[:2] and a[4] == b[4] and a[2] == (None if b[2] is None else pytest.approx(b[2], abs=1e-9)) and a[3] == (None if b[3] is None else pytest.approx(b[3], abs=1e-9))
    kept = {x[0] for x in have if x[4]}
    assert not kept & {"100", "101", "104"} and len(kept) > 80


def test_more_languages_than_are_sent_to_workers(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    few = sorted(map(str, Q.judge(df).collect()))
    monkeypatch.setattr(Q, "BROADCAST_LANGUAGES", 1)
    assert sorted(map(str, Q.judge(df).collect())) == few


def test_rows_that_pass(spark):
    rows = corpus()
    df = with_extras(spark.createDataFrame(rows, SCHEMA))
    out = Q.drop_low_quality(df)
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == sorted(x[0] for x in brute(rows) if x[4])


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "en", "hello there", "mine")], SCHEMA + ", keep string")
    assert Q.judge(df).columns == ["doc_id", "lang", "text", "n_words", "char_distance", "word_distance", "keep"]
    assert Q.judge(df).first()["keep"] is True and Q.judge(df, prefix="q_").first()["keep"] == "mine"


def test_without_a_language_column(spark):
    df = spark.createDataFrame([(1, "hello there"), (2, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["keep"]) for r in Q.judge(df).orderBy("doc_id").collect()] == [(1, True), (2, False)]


def test_empty(spark):
    assert Q.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_word_limit_falls_with_length(spark):
    r = random.Random(5)
    common = letters(r, 60).split()
    said = lambda n, share: " ".join(r.choice(common) if r.random() < share else letters(r, 1) for _ in range(n))
    rows = [(i, "en", said(600, 0.6)) for i in range(60)] + [(100, "en", said(1600, 0.23)), (101, "en", said(100, 0.6)), (102, "en", said(3000, 0.6))]
    df = spark.createDataFrame(rows, SCHEMA)
    fixed, falling = ({x["doc_id"]: x for x in Q.judge(df, falling=f).collect()} for f in (False, True))
    assert Q.LEAST_WORD_DISTANCE < falling[100]["word_distance"] < Q.MAX_WORD_DISTANCE
    assert {i for i, x in fixed.items() if not x["keep"]} == set()
    assert {i for i, x in falling.items() if not x["keep"]} == {100} == set(fixed) - {x["doc_id"] for x in Q.drop_low_quality(df).collect()}
