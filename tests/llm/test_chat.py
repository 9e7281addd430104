import random

from rows import with_extras
from sparquill.llm.chat import maximal_conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, t, role, text in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "unknown", text or ""))
    said = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, s in said.items():
        if any(len(o) > len(s) and o[: len(s)] == s for o in said.values()):
            continue
        if any(o == s and d < c for d, o in said.items()):
            continue
        out[c] = (len(s), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in s))
    return out


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in df.collect()}


def test_prefixes_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for c in range(60):
        base = rows and r.random() < 0.6
        source = [x for x in rows if x[0] == r.randrange(c)] if base else []
        turns = [x[2:] for x in source[: r.randint(1, max(1, len(source)))]]
        turns += [(r.choice(["user", "assistant"]), r.choice(["a", "b", "c"])) for _ in range(r.randint(0 if turns else 1, 3))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    assert got(maximal_conversations(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_awkward_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 0, "assistant", "tie"), (2, None, None, None), (2, 1, "user", ""), (None, 0, "user", "lost"), (3, 0, "unknown", ""), (4, 0, "user", "x" * 300_000), (5, 0, "user", "hi"), (6, 0, "unknown", None), (6, 1, "user", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(maximal_conversations(df)) == brute(rows)
    assert got(maximal_conversations(with_extras(df))) == brute(rows)


def test_text_that_looks_like_a_boundary_is_no_prefix(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "use", "ra"), (2, 1, "user", "b"), (3, 0, "user", "a\u001fb")]
    assert got(maximal_conversations(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_many_turns(spark):
    rows = [(c, t, "user", f"{t}") for c in (1, 2) for t in range(10_000 - c)]
    out = got(maximal_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert out.keys() == {1} and out[1] == brute([x for x in rows if x[0] == 1])[1]


def test_ids_of_text(spark):
    rows = [("b", 0, "user", "hi"), ("a", 0, "user", "hi"), ("c", 0, "user", "hi"), ("c", 1, "user", "ho"), ("d", 0, "user", "ho")]
    assert got(maximal_conversations(spark.createDataFrame(rows, SCHEMA.replace("conv_id long", "conv_id string")))).keys() == {"c", "d"}


def test_empty(spark):
    assert maximal_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
