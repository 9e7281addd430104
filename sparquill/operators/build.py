"""Building the tables of an index from a DataFrame of documents."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T
from ..plans.query import SEARCH_DEFAULTS, SUGGEST_DEFAULTS, check_options
from ..sources.store import cut

RESERVED = {"id", "score", "terms", "query_terms", "match"}
DEFAULTS: dict[str, Any] = {"id_field": "id", "store_fields": (), "tokenize": T.tokenize, "process_term": T.process_term, "stringify_field": T.stringify, "extract_field": lambda name: F.col(name)}


def get_default(name: str) -> Any:
    """The default of an option; the functions are Column builders."""
    if name not in DEFAULTS:
        raise KeyError(f"unknown option: {name}")
    return DEFAULTS[name]


@dataclass(frozen=True)
class IndexOptions:
    fields: tuple[str, ...]
    id_field: str = "id"
    store_fields: tuple[str, ...] = ()
    #: Column that orders documents; by default the id.
    order_by: str | None = None
    extract_field: Callable[[str], Column] = DEFAULTS["extract_field"]
    stringify_field: Callable[[Column, str], Column] | None = None
    tokenize: T.Tokenizer = T.tokenize
    process_term: T.TermProcessor = T.process_term
    #: Whether ``process_term`` gives arrays.
    term_arrays: bool = False
    search_options: dict[str, Any] = field(default_factory=dict)
    auto_suggest_options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.fields:
            raise ValueError("option 'fields' must name at least one field")
        taken = RESERVED & set(self.store_fields)
        if taken:
            raise ValueError(f"reserved names can't be stored fields: {', '.join(sorted(taken))}")
        check_options(self.search_options)
        check_options(self.auto_suggest_options)

    @property
    def search(self) -> dict[str, Any]:
        return {**SEARCH_DEFAULTS, **self.search_options}

    @property
    def suggest(self) -> dict[str, Any]:
        return {**SUGGEST_DEFAULTS, **self.auto_suggest_options}


@dataclass
class Tables:
    """An index: documents, postings and what is known of fields.

    docs(doc_ord, ext_id, stored struct or absent), postings(term, field_id, doc_ord, tf, len, df),
    terms(term, field_id, df), lengths(doc_ord, field_id, len).
    """

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    averages: tuple[float, ...]
    count: int
    #: Postings without df, if they can be had more cheaply.
    counted: DataFrame | None = None
    #: Number of postings, if it is known.
    size: int | None = None
    #: Whether the dictionary is a table that was written, so that looking into it is cheaper than counting postings.
    listed: bool = False

    @property
    def bare(self) -> DataFrame:
        """Postings for what needs no df, or brings its own."""
        return self.postings if self.counted is None else self.counted

    def frequencies(self, cond: Column) -> DataFrame:
        """(term, field_id, df) of the terms that meet a condition on term and field_id."""
        if self.counted is None or self.listed:
            return self.terms.where(cond)
        return self.counted.where(cond).groupBy("term", "field_id").agg(F.count("*").alias("df"))

    def pieces(self) -> int:
        """Partitions for work on all postings by term."""
        if self.size is None:
            self.size = self.bare.count()
        return pieces(self.size, most=MOST)


#: Rows of postings that a task sorts or sums up at a time; partitions by term at most, whose tasks hold a row for each
#: distinct term only. Up to so many partitions Spark writes a shuffle without sorting it in memory.
ROWS, MOST = 1_000_000, 200
#: Documents whose texts one task takes apart.
TEXTS = 5_000


def pieces(rows: int, each: int | None = None, most: int | None = None) -> int:
    """Number of partitions that hold about ``each`` rows, ``ROWS`` by default, so that a task's memory doesn't follow the input's size."""
    n = max(1, -(-rows // (each or ROWS)))
    return n if most is None else min(n, most)


def spread(df: DataFrame, rows: int, *by: str, each: int | None = None) -> DataFrame:
    """Rows laid out by their keys where the session's number of partitions would make them larger than ``each``."""
    n = pieces(rows, each)
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def with_ordinal(df: DataFrame, order: Column, ident: Column, out: str) -> DataFrame:
    """Number rows 0..n-1 in the order of (order, ident), ident being distinct; no partition holds all rows.

    Only the keys are sorted and numbered, partition by partition, in a table of their own that the rows are joined with.
    """
    keys = df.select(ident.alias("_k"), order.alias("_o")).repartitionByRange("_o", "_k").sortWithinPartitions("_o", "_k")
    numbered = cut(keys.select("_k", F.spark_partition_id().alias("_p"), (F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias("_i")))
    sizes = {r["_p"]: r["n"] for r in numbered.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("_p") + 1)
    return df.withColumn("_k", ident).join(numbered.select("_k", (offset + F.col("_i")).alias(out)), "_k").drop("_k")


#: Documents whose lengths are folded in one task.
FOLD = 1_000_000


def average_lengths(lengths: DataFrame, fields: int, count: int) -> tuple[float, ...]:
    """The running average of each field's length, as single-precision numbers.

    A document without the field leaves the average as it is but counts on. Where none lacks it that is the mean.
    Otherwise the n-th document's length has the weight 1 / n times (m - 1) / m for each later document m that has the
    field. Runs of documents sum this up by themselves, and each sum is scaled by what the later runs have.
    """
    plain = {r["field_id"]: (r["n"], r["mean"]) for r in lengths.where("len is not null").groupBy("field_id").agg(F.count("*").alias("n"), F.avg("len").alias("mean")).collect()}
    gaps = [f for f in range(fields) if 0 < plain.get(f, (0, 0))[0] < count]
    out = {f: m for f, (n, m) in plain.items() if n == count}
    if gaps:
        docs = with_ordinal(lengths.select("doc_ord").distinct(), F.col("doc_ord"), F.col("doc_ord"), "n")
        has = docs.join(lengths.where(F.col("field_id").isin(gaps) & F.col("len").isNotNull()), "doc_ord").select("field_id", "len", "n", F.floor(F.col("n") / FOLD).alias("run"))
        # The first document has no average before it, so its factor doesn't matter.
        shrink = F.when(F.col("n") > 0, F.log(F.col("n") / (F.col("n") + 1))).otherwise(0.0)
        later = F.coalesce(F.sum("s").over(Window.partitionBy("run", "field_id").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        runs = has.withColumn("s", shrink).withColumn("part", F.col("len") / (F.col("n") + 1) * F.exp(later)).groupBy("field_id", "run").agg(F.sum("part").alias("part"), F.sum("s").alias("s"))
        after: dict[int, float] = {}
        for r in sorted(runs.collect(), key=lambda r: -r["run"]):
            f = r["field_id"]
            out[f] = out.get(f, 0.0) + r["part"] * math.exp(after.get(f, 0.0))
            after[f] = after.get(f, 0.0) + r["s"]
    return tuple(float(np.float32(out.get(f, 0.0))) for f in range(fields))


def duplicate_ids(docs: DataFrame, id_field: str) -> DataFrame:
    return docs.groupBy(id_field).count().where("count > 1")


def tokenized(documents: DataFrame, o: IndexOptions) -> DataFrame:
    """(doc_ord, len_0, n_0, terms_0, ...): of each field the number of distinct tokens, and the array of its terms with
    their frequencies and the length of that; null where the field is.

    A document's terms are sorted and counted within its row, so no task holds more than one document for it.
    """
    raw = []
    for i, name in enumerate(o.fields):
        value = o.extract_field(name)
        kind = documents.select(value.alias("v")).schema["v"].dataType
        text = value if isinstance(kind, K.StringType) else (o.stringify_field(value, name) if o.stringify_field else T.stringify(value, kind.simpleString()))
        raw.append(F.when(value.isNotNull(), o.tokenize(F.coalesce(text, F.lit("")), name)).alias(f"tok_{i}"))
    out = documents.select("doc_ord", *raw)
    # Each step is a projection of its own: arrays that are used more than once are made once.
    fields = range(len(o.fields))
    made: list[Column] = []
    for i in fields:
        tok = F.col(f"tok_{i}")
        made += [F.when(tok.isNotNull(), T.field_length(tok)).alias(f"len_{i}"), F.when(tok.isNotNull(), F.sort_array(T.processed_terms(tok, o.process_term, o.term_arrays))).alias(f"said_{i}")]
    out = out.select("doc_ord", *made).withColumns({f"starts_{i}": T.run_starts(F.col(f"said_{i}")) for i in fields})
    made = []
    for i in fields:
        starts = F.col(f"starts_{i}")
        made += [F.col(f"len_{i}"), F.when(starts.isNotNull(), F.size(starts)).alias(f"n_{i}"), T.runs(F.col(f"said_{i}"), starts).alias(f"terms_{i}")]
    return out.select("doc_ord", *made)


def with_df(counted: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """Postings with the document frequencies of their terms, which lie in ``n`` partitions by term.

    A task holds its terms as a table, not its postings, however common a term is.
    """
    return counted.repartition(n, "term").join(terms.hint("shuffle_hash"), ["term", "field_id"])


def build(documents: DataFrame, o: IndexOptions) -> Tables:
    """The tables of an index. Ids must be there and differ.

    Texts are taken apart once, into a table of a row for each document; postings, lengths and terms are made of it.
    """
    ident = o.extract_field(o.id_field)
    # One pass finds both faults, and the number of documents.
    facts = documents.groupBy(ident.alias("i")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max(F.when(F.col("i").isNull(), F.col("n"))).alias("nulls")).first()
    if facts["nulls"]:
        raise ValueError(f"document has no ID in field '{o.id_field}'")
    if (facts["most"] or 0) > 1:
        raise ValueError("duplicate ID")
    count = facts["n"] or 0
    order = o.order_by or o.id_field
    kind = documents.schema[order].dataType if order in documents.columns else None
    if isinstance(kind, (K.LongType, K.IntegerType, K.ShortType, K.ByteType)):
        numbered = documents.withColumn("doc_ord", F.col(order).cast("long"))
    else:
        numbered = with_ordinal(documents, F.col(f"`{order}`") if kind is not None else ident, ident, "doc_ord")
    docs = numbered.select("doc_ord", ident.alias("ext_id"), *([F.struct(*[o.extract_field(s).alias(s) for s in o.store_fields]).alias("stored")] if o.store_fields else []))
    # Input may come in one part, which would leave its texts to one task.
    tasks = min(count, max(pieces(count, TEXTS), documents.sparkSession.sparkContext.defaultParallelism)) or 1
    forward = cut(tokenized(numbered.repartition(tasks, "doc_ord"), o))
    fields = range(len(o.fields))
    lengths = forward.select("doc_ord", F.posexplode(F.array(*[F.col(f"len_{i}") for i in fields])).alias("field_id", "len"))
    each = [forward.select("doc_ord", F.lit(i).alias("field_id"), F.col(f"len_{i}").alias("len"), F.explode(f"terms_{i}").alias("x")) for i in fields]
    counted = reduce(DataFrame.unionByName, each).select(F.col("x.term").alias("term"), "field_id", "doc_ord", F.col("x.tf").alias("tf"), "len")
    size = forward.agg(F.sum(sum((F.coalesce(f"n_{i}", F.lit(0)) for i in fields), F.lit(0).cast("long"))).alias("n")).first()["n"] or 0
    n = pieces(size, most=MOST)
    terms = counted.select("term", "field_id").repartition(n, "term").groupBy("term", "field_id").agg(F.count("*").alias("df"))
    return Tables(docs, with_df(counted, terms, n), terms, lengths, average_lengths(lengths, len(o.fields), count), count, counted, size)
