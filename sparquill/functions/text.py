"""Text functions: tokenizers and term processors as Column builders, with the same things for query strings on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks, all separators and all punctuation; a tab is none of these.
BREAKS = r"[\n\r\p{Z}\p{P}]+"
_BREAKS = regex.compile(BREAKS)

#: Column of text, name of its field -> Column of array<string>.
Tokenizer = Callable[[Column, str], Column]
#: Column of a token -> Column of string or array<string>; null and '' mean no term.
TermProcessor = Callable[[Column], Column]

MAX_FREQUENCY = 65535


def tokenize(text: Column, field: str = "") -> Column:
    """Default tokenizer; keeps empty tokens at the ends."""
    return F.split(text, BREAKS, -1)


def tokenize_text(text: str) -> list[str]:
    return _BREAKS.split(text)


def process_term(token: Column) -> Column:
    return F.lower(token)


def process_token(token: str) -> str:
    return token.lower()


def stringify(value: Column, kind: str) -> Column:
    """Default text of a value: arrays joined by commas, everything else cast."""
    return F.array_join(value.cast("array<string>"), ",", "") if kind.startswith("array") else value.cast("string")


def processed_terms(tokens: Column, processor: TermProcessor, array: bool) -> Column:
    """Terms of an array of tokens. A processor of strings drops null and ''; of arrays it keeps all but nulls."""
    out = F.transform(tokens, processor)
    if array:
        return F.filter(F.flatten(F.filter(out, lambda x: x.isNotNull())), lambda x: x.isNotNull())
    return F.filter(out, lambda x: x.isNotNull() & (x != ""))


def field_length(tokens: Column) -> Column:
    """Number of distinct raw tokens."""
    return F.size(F.array_distinct(tokens))


def clamp_frequency(n: Column) -> Column:
    return F.least(n.cast("long"), F.lit(MAX_FREQUENCY)).cast("int")


def run_starts(items: Column) -> Column:
    """Where in a sorted array each run of equal items starts."""
    return F.when(F.size(items) == 0, F.array().cast("array<int>")).when(items.isNotNull(), F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: (i == 0) | (F.get(items, i) != F.get(items, i - 1))))


def runs(items: Column, starts: Column) -> Column:
    """(term, tf) of each run of a sorted array. Both have to be columns already, as every run refers to them."""
    return F.transform(starts, lambda at, k: F.struct(F.get(items, at).alias("term"), clamp_frequency(F.coalesce(F.get(starts, k + 1), F.size(items)) - at).alias("tf")))


def utf16_length(term: Column) -> Column:
    return (F.length(F.encode(term, "UTF-16BE")) / 2).cast("int")


def utf16_len(term: str) -> int:
    return len(term.encode("utf-16-be", "surrogatepass")) // 2


def unique_append(target: Column, more: Column) -> Column:
    return F.array_distinct(F.concat(target, more))


def camel_case_tokenize(text: Column, field: str = "") -> Column:
    """Tokens as by default, then cut before capitals within words; both the words and their parts are given."""
    words = tokenize(text, field)
    parts = F.flatten(F.transform(words, lambda w: F.split(w, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", -1)))
    return F.concat(words, F.filter(parts, lambda p: ~F.array_contains(words, p)))


def stop_words(words: Sequence[str], then: TermProcessor = process_term) -> TermProcessor:
    """A processor that drops these terms."""
    gone = list(words)
    return lambda token: F.when(then(token).isin(gone), F.lit(None)).otherwise(then(token))


def crc32(data: Column) -> Column:
    return F.crc32(data)
