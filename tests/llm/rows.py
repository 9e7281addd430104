"""Small tables for the tests of the corpus operators."""

import random

#: Names that the operators use inside; a caller's table may have them too.
CLASHES = "id key line pos g bucket slot kind path n size sig tokens bad url page rule_id item_id coverage shard salt lang2 n_words keep h1 h2 a1 s1 jaccard say conv k h".split()


def words(r, n, vocabulary=400):
    return " ".join(f"{'abcdefghij'[r.randrange(10)]}w{r.randrange(vocabulary)}" for _ in range(n))


def letters(r, n):
    """Invented words of letters only."""
    return " ".join("".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(2, 8))) for _ in range(n))


def with_extras(df):
    """The table with columns of clashing names beside its own."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"x-{c}").alias(c) for c in CLASHES if c not in df.columns])


def awkward(seed=1):
    """Documents with null ids and texts, empty, blank, very long and repeated ones."""
    r = random.Random(seed)
    base = words(r, 60)
    rows = [(1, base), (2, base), (2, base), (2, None), (3, ""), (4, "  \n\t\n"), (None, base), (None, None), (None, ""), (5, words(r, 60_000, 9000)), (6, "one"), (7, "one"), (8, "é\U0001f600 \u0000 ß"), (9, base + " tail"), (10, "." * 500)]
    return rows
