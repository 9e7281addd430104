"""Queries and their options."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions import text as T

OR, AND, AND_NOT = "or", "and", "and_not"


class _Wildcard:
    def __repr__(self) -> str:
        return "WILDCARD"


#: Matches every document; known by identity.
WILDCARD = _Wildcard()


@dataclass(frozen=True)
class Combination:
    """Queries combined under options, which the members inherit."""

    queries: tuple
    options: dict[str, Any] = field(default_factory=dict)

    def __init__(self, queries, **options: Any):
        object.__setattr__(self, "queries", tuple(queries))
        object.__setattr__(self, "options", options)


Query = Any  # str | Combination | WILDCARD

#: Search options where nothing else is said. ``fields``, ``filter``, ``boost_term``, ``boost_document``, ``tokenize`` and
#: ``process_term`` may be given too; the last two take strings, and stand for the index's own in the query.
SEARCH_DEFAULTS: dict[str, Any] = {"combine_with": OR, "prefix": False, "fuzzy": False, "max_fuzzy": 6, "boost": {}, "weights": {"fuzzy": 0.45, "prefix": 0.375}, "bm25": None}
SUGGEST_DEFAULTS: dict[str, Any] = {"combine_with": AND, "prefix": lambda term, i, terms: i == len(terms) - 1}
KNOWN = {*SEARCH_DEFAULTS, "fields", "filter", "boost_term", "boost_document", "tokenize", "process_term"}


def operator_of(name: str) -> str:
    op = str(name).lower()
    if op not in (OR, AND, AND_NOT):
        raise ValueError(f"invalid combination operator: {name}")
    return op


def check_options(options: dict[str, Any]) -> None:
    unknown = set(options) - KNOWN
    if unknown:
        raise TypeError(f"unknown search options: {', '.join(sorted(unknown))}")


def has_wildcard(query: Query) -> bool:
    return query is WILDCARD or isinstance(query, Combination) and any(map(has_wildcard, query.queries))


@dataclass(frozen=True)
class Spec:
    """One query term and how it may match."""

    no: int
    term: str
    prefix: bool
    distance: int
    boost: float


def specs_of(terms: list[str], options: dict[str, Any]) -> list[Spec]:
    from ..functions.scoring import max_distance

    out = []
    for i, t in enumerate(terms):
        fuzzy, prefix, boost = options["fuzzy"], options["prefix"], options.get("boost_term")
        fuzzy = fuzzy(t, i, terms) if callable(fuzzy) else fuzzy
        prefix = prefix(t, i, terms) if callable(prefix) else prefix is True
        distance = max_distance(T.utf16_len(t), fuzzy, options["max_fuzzy"])
        out.append(Spec(i, t, bool(prefix), distance, float(boost(t, i, terms)) if boost else 1.0))
    return out
