import math
import random
import re

from rows import awkward, letters, with_extras
from sparquill.llm import licenses as S

SCHEMA = "doc_id long, text string"


def toks(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(text):
    """Every template at every place, without an index."""
    words, found = toks(text), []
    for t, template in enumerate(S.TEMPLATES):
        tw = toks(template.text)
        slack = min(8, len(tw) // 10)
        for start in range(-len(tw) - slack, len(words) + slack):
            n = sum(any(0 <= start + i + j < len(words) and words[start + i + j] == w for j in range(-slack, slack + 1)) for i, w in enumerate(tw))
            if n < math.ceil(S.COVERAGE * len(tw) - 1e-9):
                continue
            exact = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(tw))
            span = " " + " ".join(words[max(0, start - slack) : max(0, start + len(tw) + slack)]) + " "
            if all(" " + " ".join(toks(p)) + " " in span for p in template.phrases):
                found.append((n / len(tw), exact, len(tw), start, t))
    found.sort(key=lambda x: (-x[2], -x[0], -x[1], x[3], x[4]))
    out, taken = [], []
    for share, _, length, start, t in found:
        if not any(s < start + length and start < e for s, e in taken):
            taken.append((start, start + length))
            out.append((S.TEMPLATES[t].license, start, round(share, 6)))
    return sorted(out)


def corpus():
    r = random.Random(6)
    rows = []
    for n in range(120):
        parts = [letters(r, r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            t = r.choice(S.TEMPLATES).text
            if r.random() < 0.4:
                w = t.split()
                for _ in range(r.randint(1, 2)):
                    w[r.randrange(len(w))] = r.choice(["other", "license", "mit"])
                if r.random() < 0.6:
                    w.insert(r.randrange(len(w)), "inserted")
                t = " ".join(w)
            parts += [t.upper() if r.random() < 0.2 else t, letters(r, r.randint(0, 8))]
        rows.append((n, r.choice([" ", ". ", "\n# "]).join(parts)))
    return rows + [(200, "the Software and associated documentation files"), (201, "MIT License"), (202, "rights all reserved")]


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["license"], r["position"], r["coverage"]))
    return {k: sorted(v) for k, v in out.items()}


def test_against_brute_force(spark):
    rows = corpus()
    want = {i: brute(t) for i, t in rows if brute(t)}
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(want) > 60 and got(S.scan_licenses(df)) == want == got(S.scan_licenses(with_extras(df)))


def test_words_put_in_or_left_out():
    index = S.Index(S.TEMPLATES, 0, {}, S.COVERAGE)
    notice = next(t.text for t in S.TEMPLATES if t.license == "AGPL-3.0" and len(t.text) > 100)
    w = notice.split()
    changed = " ".join(["// some code"] + w[:9] + ["it", "or", "not"] + w[9:14] + w[15:] + ["more"])
    assert [x[0] for x in index.scan(changed)] == ["AGPL-3.0"]
    assert [x[0] for x in index.scan("# SPDX-License-Identifier: AGPL-3.0-only\nx = 1")] == ["AGPL-3.0"]
    assert index.scan("The licence of this program is free of conditions that apply to software or a general public") == []


def test_awkward_rows(spark):
    notice = "Released under the MIT License"
    rows = awkward() + [(50, notice), (50, notice), (None, notice), (51, "x " * 100_000 + notice)]
    found = got(S.scan_licenses(with_extras(spark.createDataFrame(rows, SCHEMA))))
    assert found == {50: [("MIT", 0, 1.0)] * 2, None: [("MIT", 0, 1.0)], 51: [("MIT", 100_000, 1.0)]}


def test_empty(spark):
    assert S.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
