"""The search semantics as SQL text, against which the compiled plans are held.

A field is (name, SQL expression). Postings, lengths and document frequencies are common table expressions; a query
node is a SELECT of (id, s, q): document, sum of contributions, and the distinct query terms that it met.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

BREAKS = r"[\n\r\p{Z}\p{P}]+"


def tokens(expr: str) -> str:
    return f"string_split_regex({expr}, '{BREAKS}')"


@dataclass(frozen=True)
class Corpus:
    """A table to be indexed, in SQL."""

    table: str
    ident: str
    fields: tuple[tuple[str, str], ...]
    #: SQL of a field's raw tokens, and of a token's term (null or '' for none).
    tokenize: Any = tokens
    term: str = "lower(raw)"

    def base(self) -> str:
        k = " UNION ALL ".join(f"SELECT {self.ident} AS id, {i} AS f, {self.tokenize(e)} AS tk FROM {self.table} WHERE {e} IS NOT NULL" for i, (_, e) in enumerate(self.fields))
        return f"""
 k AS ({k}),
 fl AS (SELECT id, f, len(list_distinct(tk)) AS dl FROM k),
 st AS (SELECT f, avg(dl)::float::double AS a FROM fl GROUP BY f),
 nn AS (SELECT count(*)::double AS n FROM {self.table}),
 po AS (SELECT id, f, term, least(count(*), 65535) AS tf FROM (SELECT id, f, {self.term} AS term FROM (SELECT id, f, unnest(tk) AS raw FROM k)) WHERE term <> '' GROUP BY ALL),
 dd AS (SELECT f, term, count(*)::double AS df FROM po GROUP BY ALL)"""

    def number(self, name: str) -> int:
        return [n for n, _ in self.fields].index(name)


@dataclass(frozen=True)
class Words:
    """A string query in SQL: its terms in order, and what is wanted of each."""

    terms: tuple[str, ...]
    op: str = "or"
    prefix: tuple[bool, ...] | bool = False
    #: Edit distances allowed.
    distance: tuple[int, ...] | int = 0
    fields: tuple[str, ...] = ()
    boost: dict[str, float] = field(default_factory=dict)
    term_boost: tuple[float, ...] = ()
    weights: tuple[float, float] = (0.375, 0.45)
    bm25: tuple[float, float, float] = (1.2, 0.7, 0.5)
    #: SQL of a factor for (id, term) rows of ``po``; null or 0 drops the posting.
    doc_boost: str = "1.0::double"


@dataclass(frozen=True)
class Nested:
    parts: tuple[Any, ...]
    op: str


def _contributions(c: Corpus, w: Words, only: slice = slice(None)) -> str:
    of = lambda x, i: x[i] if isinstance(x, tuple) else x
    rows = ", ".join(f"({i}, '{t}', {str(bool(of(w.prefix, i))).lower()}, {of(w.distance, i)}, {(w.term_boost or (1.0,) * len(w.terms))[i]}::double)" for i, t in list(enumerate(w.terms))[only])
    wanted = [c.number(n) for n in w.fields] if w.fields else range(len(c.fields))
    k, b, d = w.bm25
    weight = "CASE " + " ".join(f"WHEN f = {c.number(n)} THEN {v}::double" for n, v in w.boost.items()) + " ELSE 1.0::double END" if w.boost else "1.0::double"
    # The edit distance of DuckDB counts bytes; query terms are ASCII, so any one byte can stand for another letter.
    return f"""SELECT po.id, spec, q, kind, po.term, f, {w.doc_boost} * tw * tb * {weight} * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * ({d}::double + tf * {k + 1}::double / (tf + {k}::double * ({round(1 - b, 12)}::double + {b}::double / a * dl))) AS w
 FROM po JOIN (SELECT *, CASE kind WHEN 0 THEN 1.0::double WHEN 1 THEN {w.weights[0]}::double * l / (l + 0.3::double * (l - length(q))) ELSE {w.weights[1]}::double * l / (l + lev) END AS tw
   FROM (SELECT *, CASE WHEN t = q THEN 0 WHEN pre AND starts_with(t, q) THEN 1 WHEN lev <= dist THEN 2 END AS kind
     FROM (SELECT spec, q, pre, dist, tb, t, length(t)::double AS l, CASE WHEN dist > 0 THEN levenshtein(regexp_replace(t, '[^\\x00-\\x7f]', '#', 'g'), q) ELSE 1000 END AS lev
       FROM (SELECT DISTINCT term AS t FROM po), (VALUES {rows}) v(spec, q, pre, dist, tb))) WHERE kind IS NOT NULL) e ON po.term = e.t
 JOIN dd USING (f, term) JOIN fl USING (id, f) JOIN st USING (f), nn WHERE f IN ({', '.join(map(str, wanted))}) AND coalesce({w.doc_boost}, 0) <> 0"""


def node(c: Corpus, q: Words | Nested) -> str:
    if isinstance(q, Words):
        if q.op == "and_not" and len(q.terms) > 1:
            first, rest = _contributions(c, q, slice(0, 1)), _contributions(c, q, slice(1, None))
            return f"SELECT id, sum(w) AS s, list(DISTINCT q) AS q FROM ({first}) WHERE id NOT IN (SELECT id FROM ({rest})) GROUP BY id"
        having = f" HAVING count(DISTINCT spec) = {len(q.terms)}" if q.op == "and" else ""
        return f"SELECT id, sum(w) AS s, list(DISTINCT q) AS q FROM ({_contributions(c, q)}) GROUP BY id{having}"
    parts = [node(c, p) for p in q.parts]
    if q.op == "and_not":
        gone = " UNION ALL ".join(f"SELECT id FROM ({p})" for p in parts[1:])
        return f"SELECT * FROM ({parts[0]}) WHERE id NOT IN ({gone})"
    having = f" HAVING count(*) = {len(parts)}" if q.op == "and" else ""
    return f"SELECT id, sum(s) AS s, list_distinct(flatten(list(q))) AS q FROM ({' UNION ALL '.join(f'SELECT id, s, q FROM ({p})' for p in parts)}) GROUP BY id{having}"


def search(c: Corpus, q: Words | Nested, out: str = "id AS doc_id", join: str = "", where: str = "", limit: str = "") -> str:
    """(doc_id, score) and what ``out`` says; ``join`` is put after the result r(id, score, words)."""
    return f"WITH {c.base()},\n r AS (SELECT id, round(s * greatest(len(q), 1), 6) AS score, len(q) AS words FROM ({node(c, q)}))\nSELECT {out}, score FROM r {join} {where} {limit}"


def matches(c: Corpus, q: Words) -> str:
    """(doc_id, term, field): which index terms were met, and in which fields."""
    names = ", ".join(f"({i}, '{n}')" for i, (n, _) in enumerate(c.fields))
    return f"WITH {c.base()},\n r AS ({_contributions(c, q)})\nSELECT DISTINCT id AS doc_id, term, name AS field FROM r JOIN (VALUES {names}) v(f, name) USING (f)"


def suggest(c: Corpus, q: Words, where: str = "true") -> str:
    """(suggestion, score) of a query whose terms all have to match; terms stand in the order of first touch."""
    last = len(q.terms)
    return f"""WITH {c.base()},
 h AS ({_contributions(c, q)}),
 full_ids AS (SELECT id, sum(w) * count(DISTINCT q) AS score FROM h GROUP BY id HAVING count(DISTINCT spec) = {last}),
 touch AS (SELECT id, term, min((spec, kind, CASE WHEN kind = 2 THEN '' ELSE term END)) AS fst, arg_min(rk, (spec, kind, rk)) AS rk FROM (SELECT *, CASE WHEN kind = 2 THEN row_number() OVER (PARTITION BY spec, kind ORDER BY term DESC) ELSE 0 END AS rk FROM h) GROUP BY ALL),
 ph AS (SELECT id, string_agg(term, ' ' ORDER BY fst[1], fst[2], rk, fst[3]) AS suggestion FROM touch JOIN full_ids USING (id) JOIN {c.table} t ON t.{c.ident} = id WHERE {where} GROUP BY id)
SELECT suggestion, round(avg(score), 6) AS score FROM ph JOIN full_ids USING (id) GROUP BY suggestion"""
