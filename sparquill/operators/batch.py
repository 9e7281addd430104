"""Many queries in one plan: query terms and dictionary meet in joins, and every key has the query's id."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..plans.query import AND, AND_NOT, OR, operator_of
from ..sources.store import cut
from .build import IndexOptions, Tables, pieces


def query_specs(queries: DataFrame, options: IndexOptions, o: dict[str, Any]) -> DataFrame:
    """(query_id, spec, q, n) of each query's terms; tokenized by the index's own Column functions."""
    if any(callable(o.get(k)) for k in ("prefix", "fuzzy", "boost_term", "tokenize", "process_term", "boost_document")):
        raise TypeError("a batch of queries takes no functions as options")
    tokens = options.tokenize(F.coalesce(F.col("query"), F.lit("")), "")
    terms = F.filter(T.processed_terms(tokens, options.process_term, options.term_arrays), lambda t: t != "")
    rows = queries.select("query_id", terms.alias("ts"))
    return rows.select("query_id", F.size("ts").alias("n"), F.posexplode("ts").alias("spec", "q"))


def matched_terms(specs: DataFrame, terms: DataFrame, o: dict[str, Any]) -> DataFrame:
    """(q, term, w): for each distinct query term the dictionary terms that it matches, as equi-joins."""
    q = specs.select("q").distinct()
    vocabulary = terms.select("term").distinct()
    length = T.utf16_length(F.col("term")).cast("double")
    n = T.utf16_length(F.col("q")).cast("double")
    weights = {"fuzzy": 0.45, "prefix": 0.375, **(o.get("weights") or {})}
    out = q.join(vocabulary.withColumn("q", F.col("term")), "q").select("q", "term", F.lit(1.0).alias("w"))
    if o["prefix"] is True:
        # Terms are met by a head as long as the shortest query term allows, one of at most three letters.
        head = lambda c, k: F.substring(c, 1, k)
        for k in (1, 2, 3):
            own = q.where(F.length("q") == k) if k < 3 else q.where(F.length("q") >= 3)
            near = own.withColumn("h", head("q", k)).join(vocabulary.where(F.length("term") >= k).withColumn("h", head("term", k)), "h").where(F.col("term").startswith(F.col("q")) & (F.col("term") != F.col("q")))
            out = out.unionByName(near.select("q", "term", (F.lit(float(weights["prefix"])) * length / (length + F.lit(0.3) * (length - n))).alias("w")))
    f = o["fuzzy"]
    if f:
        f = 0.2 if f is True else float(f)
        k = F.least(F.lit(o["max_fuzzy"]), F.floor(n * F.lit(f) + F.lit(0.5))).cast("int") if f < 1 else F.lit(int(f))
        reach = q.withColumn("k", k).where("k > 0")
        near = within_distance(reach, vocabulary, int(o["max_fuzzy"]) if f < 1 else int(f))
        if o["prefix"] is True:
            near = near.where(~F.col("term").startswith(F.col("q")))
        out = out.unionByName(near.select("q", "term", (F.lit(float(weights["fuzzy"])) * length / (length + F.col("d").cast("double"))).alias("w")))
    return out


def within_distance(reach: DataFrame, vocabulary: DataFrame, most: int) -> DataFrame:
    """(q, term, d): the terms at an edit distance d from 1 to k of each (q, k), k at most ``most``.

    Of k + 1 pieces of q one stays whole under k edits, and moves by k places at most, so q and term meet by a piece,
    its place and the term's length. A q of no more than k letters has no such pieces; it meets terms by length alone.
    """
    n = F.length("q")
    size = F.floor(n / (F.col("k") + 1)).cast("int")
    lengths = F.explode(F.sequence(F.greatest(F.lit(0), n - F.col("k")), n + F.col("k")))
    brief = reach.where(n <= F.col("k")).withColumn("l", lengths).join(vocabulary.withColumn("l", F.length("term")), "l").select("q", "k", "term")
    cut_up = reach.where(n > F.col("k")).withColumn("size", size)
    pieces = cut_up.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("from", F.col("i") * F.col("size"))
    pieces = pieces.withColumn("piece", F.expr("substring(q, from + 1, size)")).withColumn("l", lengths)
    pieces = pieces.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("from") - F.col("k")), F.col("from") + F.col("k"))))
    # Terms are cut into pieces of those sizes only that the queries have.
    sizes = sorted(r["size"] for r in cut_up.select("size").distinct().collect()) or [1]
    parts = vocabulary.withColumn("l", F.length("term")).withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("l >= size")
    parts = parts.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("l") - F.col("size")))).withColumn("piece", F.expr("substring(term, at + 1, size)"))
    met = pieces.join(parts.select("term", "l", "at", "piece", "size"), ["piece", "size", "l", "at"]).select("q", "k", "term").unionByName(brief).distinct()
    far = F.lit(None).cast("int")
    for k in range(most, 0, -1):
        far = F.when(F.col("k") == k, F.levenshtein("term", "q", k)).otherwise(far)
    return met.withColumn("d", far).where("d between 1 and k")


#: Scores are summed up as whole numbers of 2 ** -20 and 2 ** -60 of a scale, which come to the same in any order; so
#: documents alike have scores alike to the last bit, whatever the partitioning.
HIGH, LOW = float(1 << 20), float(1 << 40)


def scale_of(boosts: list[tuple[int, float]], o: dict[str, Any]) -> float:
    """A power of two that no boost or parameter of the score is far above."""
    p = o.get("bm25") or S.BM25()
    weights = (o.get("weights") or {}).values()
    return 2.0 ** math.ceil(math.log2(max([1.0, abs(p.k) + abs(p.d), *(abs(b) for _, b in boosts)]) * max([1.0, *map(abs, weights)])))


#: Rows that are broadcast at most, and pairs of a query and a document that a task sums up.
FEW, PAIRS = 200_000, 500_000


def search_many(tables: Tables, options: IndexOptions, queries: DataFrame, o: dict[str, Any], limit: int | None) -> DataFrame:
    """(query_id, id, score, rank). Every query is answered; ``limit`` keeps the best of each.

    Postings that queries ask for move once, to their documents; there they meet the queries, are summed up and get their
    ids. So pairs of queries and documents don't move, but for those that a ``limit`` leaves.
    """
    op = operator_of(o.get("combine_with") or OR)
    specs = cut(query_specs(queries, options, o))
    names = [f for f in dict.fromkeys(o.get("fields") or options.fields) if f in options.fields]
    pairs = [(options.fields.index(f), float((o.get("boost") or {}).get(f) or 1.0)) for f in names]
    if not pairs:
        pairs = [(-1, 1.0)]
    within = F.col("field_id").isin([i for i, _ in pairs])
    if o["prefix"] is True or o["fuzzy"]:
        matched = matched_terms(specs, tables.terms if tables.counted is None or tables.listed else cut(tables.terms), o)
    else:
        matched = specs.select("q").distinct().withColumn("term", F.col("q")).withColumn("w", F.lit(1.0))
    matched = cut(matched)
    small = lambda df, n: F.broadcast(df) if n <= FEW else df
    n = matched.count()
    asked = matched.select("term").distinct()
    if tables.counted is None or tables.listed:
        found = tables.terms.where(within).join(small(asked, n), "term", "left_semi")
    else:
        found = tables.counted.where(within).join(small(asked, n), "term", "left_semi").groupBy("term", "field_id").agg(F.count("*").alias("df"))
    # The query terms get numbers, which postings take along.
    numbered = cut(specs.select("q").distinct().withColumn("no", F.monotonically_increasing_id()))
    known = cut(found.join(matched, "term").join(numbered, "q").select("term", "field_id", "df", "no", "w"))
    # Of a query's equal terms one row tells how often they stand there.
    asks = cut(specs.groupBy("query_id", "q").agg(F.count("*").alias("times"), F.max(F.when(F.col("spec") == 0, 1)).alias("first"), F.first("n").alias("n")).join(numbered, "q").drop("q"))
    facts = asks.agg(F.count("*").alias("rows"), F.count_distinct("query_id").alias("queries"), F.max(F.col("query_id").isNull().cast("int")).alias("null")).first()
    met = known.groupBy("no").agg(F.count("*").alias("n"), F.sum("df").alias("df"))
    rows = asks.join(met, "no").agg(F.sum("df").alias("rows")).first()["rows"] or 0
    n = known.count()
    tasks = pieces(min(rows, tables.count * (facts["queries"] + (facts["null"] or 0))), PAIRS)
    choose = lambda values: F.element_at(F.create_map(*[x for k, v in values for x in (F.lit(k), F.lit(v))]), F.col("field_id"))
    average = choose([(i, tables.averages[i] if i >= 0 else 1.0) for i, _ in pairs])
    p = tables.bare.where(within).select("term", "field_id", "doc_ord", "tf", "len").join(small(known, n), ["term", "field_id"])
    score = S.bm25(F.col("tf").cast("double"), F.col("df").cast("double"), F.lit(float(tables.count)), F.col("len").cast("double"), average, o.get("bm25") or S.BM25())
    w = F.col("w") * choose(pairs) * score / F.lit(scale_of(pairs, o))
    # Each posting is scored once for a query term, however many queries have it.
    each = p.withColumn("hi", F.floor(w * HIGH)).withColumn("lo", F.floor((w * HIGH - F.col("hi")) * LOW)).select("no", "doc_ord", "hi", "lo").repartition(tasks, "doc_ord")
    per_term = each.groupBy("no", "doc_ord").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
    both = per_term.join(small(asks, facts["rows"]), "no")
    times = lambda c: F.sum(F.col(c) * F.col("times"))
    first = lambda c: F.sum(F.when(F.col("first") == 1, F.col(c)))
    by = both.groupBy("query_id", "doc_ord").agg(times("hi").alias("hi"), times("lo").alias("lo"), first("hi").alias("hi0"), first("lo").alias("lo0"), F.count("*").alias("words"), F.sum("times").alias("met"), F.first("n").alias("n"))
    number = lambda hi, lo: (F.col(hi).cast("double") + F.col(lo).cast("double") / LOW) / HIGH * F.lit(scale_of(pairs, o))
    by = by.withColumn("score", number("hi", "lo")).withColumn("first", number("hi0", "lo0"))
    if op == AND:
        by = by.where("met = n")
    elif op == AND_NOT:
        by = by.where("first is not null and met = 1").withColumn("score", F.col("first"))
    docs = tables.docs.select("doc_ord", "ext_id").repartition(tasks, "doc_ord").hint("shuffle_hash")
    scored = by.select("query_id", "doc_ord", (F.col("score") * F.col("words")).alias("score")).join(docs, "doc_ord")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_ord")))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select("query_id", F.col("ext_id").alias("id"), "score", "rank")
