"""Quality rules by distribution divergence.

Each language of the corpus has two references, counted over all of its documents: how often each class of characters
occurs, and how often each of its most common words occurs among all words. A document's own two histograms are
compared to them by the Jensen-Shannon distance. Documents that are too short for a histogram to say anything pass.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Most common words of a language that are told apart; all others are one class.
COMMON_WORDS = 50
#: Documents of fewer characters aren't judged by character classes, those of fewer words not by words.
MIN_CHARS, MIN_WORDS = 300, 80
#: Largest distances (square root of the divergence in bits) that pass.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.22, 0.38
#: A text of n words may be WORD_NOISE / sqrt(n) away by its words, which is sampling noise; at least the second, as
#: references of few documents have noise of their own.
WORD_NOISE, LEAST_WORD_DISTANCE = 6.25, 0.15

#: Languages whose references, some sixty numbers each, are sent to the workers; with more, documents are joined with theirs.
BROADCAST_LANGUAGES = 1000

CLASSES = ("lower", "upper", "letter", "digit", "space", "stop", "other")
STOPS = ".,;:!?'\"()-"
WORDS = regex.compile(r"\p{L}+")


def _class_of(ch: str) -> int:
    kind = unicodedata.category(ch)
    if kind == "Ll":
        return 0
    if kind == "Lu":
        return 1
    if kind[0] == "L":
        return 2
    if kind == "Nd":
        return 3
    if ch in " \t\r\n":
        return 4
    return 5 if ch in STOPS else 6


@lru_cache(1)
def _classes() -> np.ndarray:
    return np.array([_class_of(chr(c)) for c in range(0x110000)], np.uint8)


def char_histogram(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_classes()[codes], minlength=len(CLASSES))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0.0).sum() + np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def _lang(docs: DataFrame, lang_col: str | None):
    return F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")) if lang_col and lang_col in docs.columns else F.lit("")


def references(docs: DataFrame, lang_col: str | None = "lang", text_col: str = "text") -> DataFrame:
    """(lang, kind, item, n): kind 'char' has each class's count, kind 'word' the common words' and '' for all others.

    Everything is counted over all documents. Words that are equally common are taken in their own order.
    """
    src = docs.select(_lang(docs, lang_col).alias("lang"), F.col(f"`{text_col}`").alias("text")).where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter[str]] = {}
        chars: dict[str, np.ndarray] = {}
        held = 0

        def rows(final: bool) -> Iterator[pa.RecordBatch]:
            for lang, c in words.items():
                items = list(c)
                for lo in range(0, len(items), 50_000):
                    part = items[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(["word"] * len(part)), pa.array(part), pa.array([c[w] for w in part], pa.int64())], ["lang", "kind", "item", "n"])
            if final:
                for lang, c in chars.items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(["char"] * len(c)), pa.array(list(CLASSES)), pa.array(c.astype(np.int64))], ["lang", "kind", "item", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORDS.findall(text.lower()))
                chars[lang] = chars.get(lang, 0) + char_histogram(text)
            held = sum(map(len, words.values()))
            if held > 600_000:
                yield from rows(False)
                words.clear()
        yield from rows(True)

    counts = cut(src.mapInArrow(count, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "item")
    words = counts.where("kind = 'word'")
    common = words.withColumn("r", F.row_number().over(best)).where(F.col("r") <= COMMON_WORDS).drop("r")
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    rest = total.join(common.groupBy("lang").agg(F.sum("n").alias("c")), "lang").select("lang", F.lit("word").alias("kind"), F.lit("").alias("item"), (F.col("n") - F.col("c")).alias("n"))
    return counts.where("kind = 'char'").unionByName(common).unionByName(rest)


def _table(rows: str) -> tuple[np.ndarray, dict[str, int], np.ndarray]:
    """A language's reference out of the JSON of its (kind, item, n)."""
    chars, words, rest = {}, [], 0
    for x in json.loads(rows):
        kind, item, n = x["kind"], x["item"], x["n"]
        if kind == "char":
            chars[item] = n
        elif item:
            words.append((item, n))
        else:
            rest = n
    words.sort()
    return np.array([chars.get(c, 0) for c in CLASSES], float), {w: i for i, (w, _) in enumerate(words)}, np.array([n for _, n in words] + [rest], float)


def distances(text: str | None, table: tuple[np.ndarray, dict[str, int], np.ndarray]) -> tuple[int, int, float | None, float | None]:
    """(characters, words, character distance, word distance); a distance is None where the text is too short for it."""
    if not text:
        return 0, 0, None, None
    chars, number, freq = table
    found = WORDS.findall(text.lower())
    by_char = distance(char_histogram(text).astype(float), chars) if len(text) >= MIN_CHARS else None
    by_word = None
    if len(found) >= MIN_WORDS:
        own = np.zeros(len(freq))
        counts = Counter(found)
        for w in number.keys() & counts.keys():
            own[number[w]] = counts[w]
        own[-1] = len(found) - own[:-1].sum()
        by_word = distance(own, freq)
    return len(text), len(found), by_char, by_word


def word_limit(n_words: Column) -> Column:
    """Largest word distance that passes, by the number of words."""
    return F.least(F.lit(MAX_WORD_DISTANCE), F.greatest(F.lit(LEAST_WORD_DISTANCE), F.lit(WORD_NOISE) / F.sqrt(n_words)))


def judge(docs: DataFrame, lang_col: str | None = "lang", text_col: str = "text", prefix: str = "", falling: bool = True) -> DataFrame:
    """``docs`` with n_words, char_distance, word_distance and keep added, each name after ``prefix``.

    The limit of the word distance falls with the number of words; without ``falling`` it is MAX_WORD_DISTANCE for all.
    The references are those of ``docs`` itself. A null language is one of its own. A null text, or one without a
    letter, isn't kept. Distances are null where the length guard holds, and such a document passes that rule.
    Repeated rows are judged alike; an empty table gives no rows. Texts are taken whole, and languages may be many. Words
    that are equally common enter the reference in their own order. Columns of the added names are replaced; a prefix saves
    them.
    """
    spark = docs.sparkSession
    lang = _lang(docs, lang_col)
    refs = cut(references(docs, lang_col, text_col).groupBy("lang").agg(F.to_json(F.collect_list(F.struct("kind", "item", "n"))).alias("_sq_ref")).withColumnRenamed("lang", "_sq_lang"))
    few = refs.limit(BROADCAST_LANGUAGES + 1).collect()
    shared = spark.sparkContext.broadcast({r["_sq_lang"]: _table(r["_sq_ref"]) for r in few} if len(few) <= BROADCAST_LANGUAGES else None)

    @F.pandas_udf("n_words int, char_distance double, word_distance double")
    def measure(refs, texts):
        import pandas as pd

        tables, known = shared.value, {}

        def table(ref):
            if tables is not None:
                return tables[ref]
            if ref not in known:
                known[ref] = _table(ref)
            return known[ref]

        rows = [distances(t, table(g)) if t else (0, 0, None, None) for g, t in zip(refs, texts, strict=True)]
        return pd.DataFrame({"n_words": pd.array([r[1] for r in rows], "int32"), "char_distance": pd.array([r[2] for r in rows], "Float64"), "word_distance": pd.array([r[3] for r in rows], "Float64")})

    added = {f"{prefix}{c}" for c in ("n_words", "char_distance", "word_distance", "keep")}
    # As it is said not to be deterministic, the filter on it isn't pushed below it, where it would be computed again.
    if len(few) <= BROADCAST_LANGUAGES:
        out = docs.withColumn("_sq_m", measure.asNondeterministic()(lang, F.col(f"`{text_col}`")))
    else:
        met = docs.withColumn("_sq_own", lang).join(refs, F.col("_sq_own") == F.col("_sq_lang"), "left")
        out = met.withColumn("_sq_m", measure.asNondeterministic()(F.col("_sq_ref"), F.col(f"`{text_col}`")))
    m = F.col("_sq_m")
    limit = word_limit(m["n_words"]) if falling else F.lit(MAX_WORD_DISTANCE)
    passes = (m["n_words"] > 0) & F.coalesce(m["char_distance"] <= MAX_CHAR_DISTANCE, F.lit(True)) & F.coalesce(m["word_distance"] <= limit, F.lit(True))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], m["n_words"].alias(f"{prefix}n_words"), m["char_distance"].alias(f"{prefix}char_distance"), m["word_distance"].alias(f"{prefix}word_distance"), passes.alias(f"{prefix}keep"))


def drop_low_quality(docs: DataFrame, lang_col: str | None = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, for all that it says; columns are left alone."""
    return judge(docs, lang_col, text_col, "_sq_").where("_sq_keep").select(*[F.col(f"`{c}`") for c in docs.columns])
