"""Compiling queries into plans.

A node of a query becomes (doc_ord, score, query_terms, found, ord). ``found`` lists matched terms with their fields in
the order of first touch; ``ord`` orders documents of equal score. What isn't selected in the end is pruned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..plans.query import AND, AND_NOT, OR, WILDCARD, Combination, Query, Spec, has_wildcard, operator_of, specs_of
from ..sources.store import cut
from .build import IndexOptions, Tables, spread

_ORD = "array<struct<a:int,b:int,c:int,d:string,e:int>>"
_FOUND = "array<struct<term:string,fields:array<string>>>"
#: Where all terms have to match, the documents of the rarest go first if all postings are so many times its own; up to so
#: many of its documents' numbers are broadcast.
GATE_RATIO, GATE_ROWS = 4, 1_000_000
#: Matched terms that are broadcast at most, and matched postings that a task collects by document.
TERM_ROWS, HIT_ROWS = 200_000, 200_000


def _mark(a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"), d.alias("d"), e.cast("int").alias("e"))


def _empty(tables: Tables) -> DataFrame:
    none = F.lit(None)
    return tables.docs.where(F.lit(False)).select("doc_ord", none.cast("double").alias("score"), none.cast("array<string>").alias("query_terms"), none.cast(_FOUND).alias("found"), none.cast(_ORD).alias("ord"))


def _kinds(spec: Spec, weights: dict[str, float]) -> list[tuple[Column, Column, Column, Column]]:
    """(condition, kind, weight, distance) of the ways in which a term can match; the first that holds counts."""
    term, length = F.col("term"), T.utf16_length(F.col("term")).cast("double")
    n = T.utf16_len(spec.term)
    out = [(term == spec.term, F.lit(0), F.lit(1.0), F.lit(0))]
    if spec.prefix:
        out.append((term.startswith(spec.term), F.lit(1), S.prefix_weight(weights["prefix"], length, n), F.lit(0)))
    if spec.distance:
        # Threshold -1: farther than allowed. The lengths are compared first, as they are cheap.
        near = F.length("term").between(len(spec.term) - spec.distance, len(spec.term) + spec.distance)
        far = F.levenshtein(term, F.lit(spec.term), spec.distance)
        out.append((near & (far >= 1), F.lit(2), S.fuzzy_weight(weights["fuzzy"], length, far.cast("double")), far))
    return out


def expansions(specs: list[Spec], weights: dict[str, float]) -> tuple[Column, Column]:
    """(whether a term matches any spec, array of the specs that it matches)."""
    conds, hits = [], []
    for s in specs:
        ways = _kinds(s, weights)
        value = None
        for cond, kind, weight, _ in ways:
            one = F.struct(F.lit(s.no).alias("spec"), kind.alias("kind"), (weight * F.lit(s.boost)).alias("w"))
            value = F.when(cond, one) if value is None else value.when(cond, one)
            conds.append(cond)
        hits.append(value)
    return reduce(lambda a, b: a | b, conds), F.filter(F.array(*hits), lambda x: x.isNotNull())


@dataclass(frozen=True)
class Known:
    """What the dictionary has of some specs: (term, field_id, df, h, rank), with the condition that finds it in postings."""

    terms: DataFrame
    some: Column
    #: Whether the condition computes edit distances.
    near: bool
    #: Of each spec its numbers of terms and of postings.
    terms_of: dict[int, int]
    postings: dict[int, int]


class Compiler:
    def __init__(self, tables: Tables, options: IndexOptions):
        self.tables, self.index = tables, options

    def compile(self, query: Query, options: dict[str, Any], ids_only: bool = False) -> DataFrame:
        """``ids_only``: which documents a query holds, whatever ``boost_document`` says."""
        if query is WILDCARD:
            return self._wildcard(options)
        if isinstance(query, Combination):
            return self._combination(query, options, ids_only)
        if not isinstance(query, str):
            raise TypeError("invalid query")
        return self._string(query, options, ids_only)

    def _wildcard(self, options: dict[str, Any]) -> DataFrame:
        boost = {**self.index.search, **options}.get("boost_document")
        score = F.lit(1.0) if boost is None else F.coalesce(F.nanvl(boost(F.col("ext_id"), F.lit(""), self._stored()).cast("double"), F.lit(0.0)), F.lit(0.0))
        return self.tables.docs.select("doc_ord", score.alias("score"), F.array().cast("array<string>").alias("query_terms"), F.array().cast(_FOUND).alias("found"), F.array().cast(_ORD).alias("ord"))

    def _stored(self) -> Column:
        return F.col("stored") if "stored" in self.tables.docs.columns else F.lit(None)

    def query_terms(self, query: str, o: dict[str, Any]) -> list[str]:
        """A query's terms. As long as the search doesn't say otherwise, it is taken apart as the index's texts were."""
        split, process, index = o.get("tokenize"), o.get("process_term"), self.index
        if split is None and index.tokenize is T.tokenize:
            split = T.tokenize_text
        if process is None and index.process_term is T.process_term and not index.term_arrays:
            process = T.process_token
        tokens = split(query) if split else None
        if process is None:
            # The index's functions make Columns; they are evaluated on one row.
            raw = index.tokenize(F.lit(query), "") if tokens is None else F.lit(list(tokens)).cast("array<string>")
            one = self.tables.docs.sparkSession.range(1)
            terms = one.select(T.processed_terms(raw, index.process_term, index.term_arrays).alias("t")).first()["t"]
        else:
            if tokens is None:
                tokens = self.tables.docs.sparkSession.range(1).select(index.tokenize(F.lit(query), "").alias("t")).first()["t"]
            terms = []
            for token in tokens:
                term = process(token)
                terms += term if isinstance(term, (list, tuple)) else [term]
        return [t for t in terms if t]

    def names(self, o: dict[str, Any]) -> list[str]:
        return [f for f in dict.fromkeys(o.get("fields") or self.index.fields) if f in self.index.fields]

    def known(self, specs: list[Spec], o: dict[str, Any]) -> Known:
        """The dictionary terms that the specs match, found in a job of their own: they are few beside the postings."""
        weights = {"fuzzy": 0.45, "prefix": 0.375, **(o.get("weights") or {})}
        ids = [self.index.fields.index(f) for f in self.names(o)]
        some, hits = expansions(specs, weights)
        grown = self.tables.frequencies(F.col("field_id").isin(ids) & some).withColumn("h", F.explode(hits))
        rank = F.lit(0)
        if any(s.distance for s in specs):
            # Later terms of a kind come first.
            by = Window.partitionBy("h.spec", "h.kind").orderBy(F.encode("term", "UTF-16BE").desc())
            rank = F.when(F.col("h.kind") == 2, F.dense_rank().over(by)).otherwise(0)
        terms = cut(grown.select("term", "field_id", "df", "h", rank.alias("rank")))
        sizes = {r["s"]: (r["n"], r["df"]) for r in terms.groupBy(F.col("h.spec").alias("s")).agg(F.count("*").alias("n"), F.sum("df").alias("df")).collect()}
        return Known(terms, some, any(s.distance for s in specs), {k: n for k, (n, _) in sizes.items()}, {k: df for k, (_, df) in sizes.items()})

    def gate(self, specs: list[Spec], known: Known, o: dict[str, Any]) -> tuple[bool, DataFrame | None]:
        """For terms that all have to match: whether any document can have them, and the documents of the rarest if that spares much.

        The postings of each term are counted in the dictionary first, which is small beside the postings.
        """
        sizes = known.postings
        if len(sizes) < len(specs):
            return False, None
        rare = min(specs, key=lambda s: (sizes[s.no], s.no))
        if sum(sizes.values()) < GATE_RATIO * sizes[rare.no]:
            return True, None
        docs = self.contributions([rare], known, o, ids_only=True).select("doc_ord").distinct()
        return True, F.broadcast(docs) if sizes[rare.no] <= GATE_ROWS else docs

    def contributions(self, specs: list[Spec], known: Known, o: dict[str, Any], ids_only: bool = False, only: DataFrame | None = None) -> DataFrame:
        """(doc_ord, spec, kind, rank, term, field_pos, w) of each posting that a spec scores; of the documents ``only``, if given."""
        names = self.names(o)
        boosts = {f: float((o.get("boost") or {}).get(f) or 1.0) for f in names}
        boosts = {f: b if b == b else 1.0 for f, b in boosts.items()}
        ids = [self.index.fields.index(f) for f in names]
        p = self.tables.bare.where(F.col("field_id").isin(ids)).select("term", "field_id", "doc_ord", "tf", "len")
        if not known.near:
            p = p.where(known.some)
        if only is not None:
            # What the terms leave of the postings is less than what they all are.
            p = p.where(known.some).join(only, "doc_ord", "left_semi")
        terms = known.terms.where(F.col("h.spec").isin([s.no for s in specs]))
        n = sum(known.terms_of.get(s.no, 0) for s in specs)
        if n <= TERM_ROWS:
            rows = p.join(F.broadcast(terms), ["term", "field_id"])
        else:
            k = self.tables.pieces()
            rows = p.where(known.some).repartition(k, "term").join(terms.repartition(k, "term").hint("shuffle_hash"), ["term", "field_id"])
        if o.get("boost_document") and not ids_only:
            cols = ["doc_ord", "ext_id", *(["stored"] if "stored" in self.tables.docs.columns else [])]
            docs = self.tables.docs.select(*cols)
            rows = rows.join(docs, "doc_ord")
            raw = o["boost_document"](F.col("ext_id"), F.col("term"), self._stored()).cast("double")
            rows = rows.withColumn("doc_boost", raw).where(F.col("doc_boost").isNotNull() & ~F.isnan("doc_boost") & (F.col("doc_boost") != 0))
        else:
            rows = rows.withColumn("doc_boost", F.lit(1.0))
        choose = lambda values: F.element_at(F.create_map(*[x for f, v in values for x in (F.lit(f), F.lit(v))]), F.col("field_id"))
        average = choose([(i, self.tables.averages[i]) for i in ids]) if ids else F.lit(1.0)
        boost = choose([(i, boosts[f]) for i, f in zip(ids, names, strict=True)]) if ids else F.lit(1.0)
        pos = choose([(i, n) for n, i in enumerate(ids)]) if ids else F.lit(0)
        score = S.bm25(F.col("tf").cast("double"), F.col("df").cast("double"), F.lit(float(self.tables.count)), F.col("len").cast("double"), average, o.get("bm25") or S.BM25())
        return rows.select("doc_ord", F.col("h.spec").alias("spec"), F.col("h.kind").alias("kind"), "rank", "term", pos.alias("field_pos"), (F.col("h.w") * boost * F.col("doc_boost") * score).alias("w"))

    def _string(self, query: str, options: dict[str, Any], ids_only: bool) -> DataFrame:
        o = {**self.index.search, **options}
        specs = specs_of(self.query_terms(query, o), o)
        if not specs:
            return _empty(self.tables)
        op = operator_of(o.get("combine_with") or OR)
        names = self.names(o)
        if not names:
            return _empty(self.tables)
        known = self.known(specs, o)
        if op == AND_NOT and len(specs) > 1:
            gone = self.contributions(specs[1:], known, o, ids_only=True).select("doc_ord").distinct()
            rows = self.contributions(specs[:1], known, o, ids_only).join(gone, "doc_ord", "left_anti")
            specs = specs[:1]
        elif op == AND and len(specs) > 1:
            may, only = self.gate(specs, known, o)
            if not may:
                return _empty(self.tables)
            rows = self.contributions(specs, known, o, ids_only, only)
        else:
            rows = self.contributions(specs, known, o, ids_only)
        rows = spread(rows, sum(known.postings.get(s.no, 0) for s in specs), "doc_ord", each=HIT_ROWS)
        fields = F.array(*[F.lit(f) for f in names])
        mark = _mark(F.col("spec"), F.col("kind"), F.col("rank"), F.when(F.col("kind") == 2, F.lit("")).otherwise(F.col("term")), F.col("field_pos"))
        hit = F.struct(mark.alias("m"), F.col("term").alias("term"), F.col("w").alias("w"))
        grouped = rows.groupBy("doc_ord").agg(F.collect_set("spec").alias("specs"), F.min(mark).alias("first"), F.sort_array(F.collect_list(hit)).alias("hits"))
        # Summed up in one order, whatever the partitioning, so that equal documents have equal scores to the last bit.
        grouped = grouped.withColumn("score", total("hits", "w"))
        if op == AND:
            grouped = grouped.where(F.size("specs") == len(specs))
        terms = F.array(*[F.lit(s.term) for s in specs])
        said = F.array_distinct(F.transform(F.array_sort("specs"), lambda i: F.element_at(terms, i + 1)))

        def fields_of(t: Column) -> Column:
            own = F.filter("hits", lambda h: h["term"] == t)
            last = F.array_max(F.transform(own, lambda h: h["m"]["a"]))
            return F.transform(F.filter(own, lambda h: h["m"]["a"] == last), lambda h: F.element_at(fields, h["m"]["e"] + 1))

        found = F.transform(F.array_distinct(F.transform("hits", lambda h: h["term"])), lambda t: F.struct(t.alias("term"), fields_of(t).alias("fields")))
        return grouped.select("doc_ord", "score", said.alias("query_terms"), found.alias("found"), F.array("first").cast(_ORD).alias("ord"))

    def _combination(self, query: Combination, options: dict[str, Any], ids_only: bool) -> DataFrame:
        passed = {**options, **query.options}
        op = operator_of(query.options.get("combine_with") or passed.get("combine_with") or self.index.search["combine_with"])
        if not query.queries:
            return _empty(self.tables)
        if op == AND_NOT:
            first = self.compile(query.queries[0], passed, ids_only)
            # Without a wildcard, documents are taken away by membership alone.
            by_id = ids_only or not has_wildcard(query)
            for other in query.queries[1:]:
                first = first.join(self.compile(other, passed, by_id).select("doc_ord"), "doc_ord", "left_anti")
            return first
        parts = [self.compile(q, passed, ids_only).withColumn("branch", F.lit(i)) for i, q in enumerate(query.queries)]
        return combine(parts, op)


def total(items: str, name: str) -> Column:
    """Sum of a number over an array of structs, from its first to its last."""
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x[name])


def combine(parts: list[DataFrame], op: str) -> DataFrame:
    """OR or AND of nodes that have a ``branch`` number."""
    rows = reduce(DataFrame.unionByName, parts)
    one = F.struct("branch", "query_terms", "found", "score")
    path = F.concat(F.array(_mark(F.col("branch"), F.lit(0), F.lit(0), F.lit(""), F.lit(0))).cast(_ORD), "ord")
    grouped = rows.groupBy("doc_ord").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(one)).alias("all"), F.min(path).alias("ord")).withColumn("score", total("all", "score"))
    if op == AND:
        grouped = grouped.where(F.col("n") == len(parts))
    entries = F.flatten(F.transform("all", lambda x: x["found"]))
    # A term keeps its first place; its fields are those of the last branch that matched it.
    found = F.transform(F.array_distinct(F.transform(entries, lambda e: e["term"])), lambda t: F.struct(t.alias("term"), F.element_at(F.filter(entries, lambda e: e["term"] == t), -1)["fields"].alias("fields")))
    return grouped.select("doc_ord", "score", F.array_distinct(F.flatten(F.transform("all", lambda x: x["query_terms"]))).alias("query_terms"), found.alias("found"), "ord")


def numbers_first(found: Column) -> Column:
    """Terms that are whole numbers below 2**32 - 1, without leading zeros, stand first in their order; the others as they were."""
    number = lambda e: e["term"].rlike("^(0|[1-9][0-9]{0,9})$") & (e["term"].try_cast("bigint") < 4294967295)
    some = F.filter(found, lambda e: F.coalesce(number(e), F.lit(False)))
    ordered = F.transform(F.array_sort(F.transform(some, lambda e: F.struct(e["term"].cast("bigint").alias("n"), e.alias("e")))), lambda x: x["e"])
    return F.concat(ordered, F.filter(found, lambda e: ~F.coalesce(number(e), F.lit(False))))


def finalize(raw: DataFrame, tables: Tables, query: Query, options: dict[str, Any], limit: int | None) -> DataFrame:
    """(id, score, terms, query_terms, match, stored fields), best first."""
    stored = "stored" in tables.docs.columns
    docs = tables.docs.select("doc_ord", "ext_id", *(["stored"] if stored else []))
    full = raw.withColumn("score", F.col("score") * F.greatest(F.size("query_terms"), F.lit(1))).join(docs, "doc_ord")
    full = full.withColumn("found", numbers_first(F.col("found")))
    match = F.map_from_entries("found")
    cols = [F.col("ext_id").alias("id"), "score", F.transform("found", lambda e: e["term"]).alias("terms"), "query_terms", match.alias("match"), *(["stored.*"] if stored else [])]
    out = full.select("ord", "doc_ord", *cols)
    keep: Column | str | Callable[[DataFrame], Column] | None = options.get("filter")
    if keep is not None:
        cond = keep(out) if callable(keep) and not isinstance(keep, Column) else F.expr(keep) if isinstance(keep, str) else keep
        out = out.where(cond)
    by = [F.col("doc_ord")] if query is WILDCARD and options.get("boost_document") is None else [F.col("score").desc(), F.col("ord"), F.col("doc_ord")]
    out = out.orderBy(*by)
    if limit is not None:
        out = out.limit(limit)
    return out.drop("ord", "doc_ord")


def suggestions(results: DataFrame) -> DataFrame:
    """(suggestion, terms, score) from search results: the mean score of each phrase of matched terms."""
    said = results.withColumn("suggestion", F.array_join("terms", " "))
    return said.groupBy("suggestion").agg(F.max_by("terms", "score").alias("terms"), F.avg("score").alias("score")).orderBy(F.col("score").desc(), "suggestion")
