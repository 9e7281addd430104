"""The search index: build, search, suggest, look up, save and load."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from .operators import search as S
from .operators.batch import search_many
from .operators.build import IndexOptions, Tables, build, duplicate_ids, get_default
from .plans.query import AND, AND_NOT, OR, WILDCARD, Query, check_options


class SearchIndex:
    """A read-only full-text index held as DataFrames."""

    wildcard = WILDCARD
    OR, AND, AND_NOT = OR, AND, AND_NOT
    get_default = staticmethod(get_default)

    def __init__(self, tables: Tables, options: IndexOptions):
        self.tables, self.options = tables, options

    @classmethod
    def from_dataframe(cls, documents: DataFrame, options: IndexOptions) -> SearchIndex:
        return cls(build(documents, options), options)

    from_documents = from_dataframe

    @property
    def document_count(self) -> int:
        return self.tables.count

    @property
    def term_count(self) -> int:
        return self.tables.terms.select("term").distinct().count()

    def cache(self) -> SearchIndex:
        """Keep postings, terms and documents for many queries."""
        for t in (self.tables.bare, self.tables.terms, self.tables.docs):
            t.persist()
        return self

    def unpersist(self) -> None:
        for t in (self.tables.bare, self.tables.terms, self.tables.docs):
            t.unpersist()

    def search(self, query: Query, limit: int | None = None, **options: Any) -> DataFrame:
        """(id, score, terms, query_terms, match, stored fields), best first.

        ``limit`` asks for the best so many. Options of the call go before those of the index; of a combination,
        ``filter`` isn't heard.
        """
        check_options(options)
        raw = S.Compiler(self.tables, self.options).compile(query, options)
        return S.finalize(raw, self.tables, query, {**self.options.search, **options}, limit)

    def auto_suggest(self, query: str, limit: int | None = None, **options: Any) -> DataFrame:
        """(suggestion, terms, score), best first. By default all terms have to match, the last as a prefix."""
        merged = {**self.options.suggest, **options}
        merged.setdefault("filter", None)
        out = S.suggestions(self.search(query, **merged))
        return out if limit is None else out.limit(limit)

    def search_many(self, queries: DataFrame, limit: int | None = None, **options: Any) -> DataFrame:
        """(query_id, id, score, rank) for a table of (query_id, query), in one job."""
        check_options(options)
        return search_many(self.tables, self.options, queries, {**self.options.search, **options}, limit)

    def has(self, ident: Any) -> bool:
        return not self._row(ident).isEmpty()

    def _row(self, ident: Any) -> DataFrame:
        kind = self.tables.docs.schema["ext_id"].dataType
        text = isinstance(kind, K.StringType)
        number = isinstance(kind, K.NumericType)
        if ident is None or isinstance(ident, str) != text or number and isinstance(ident, bool):
            return self.tables.docs.where(F.lit(False))
        return self.tables.docs.where(F.col("ext_id") == F.lit(ident))

    def lookup(self, ids: DataFrame) -> DataFrame:
        """(id, found, stored) for each row of a table whose first column holds ids; the table keeps its size."""
        kind = self.tables.docs.schema["ext_id"].dataType
        own = ids.select(F.col(f"`{ids.columns[0]}`").alias("id"))
        if isinstance(own.schema["id"].dataType, K.StringType) != isinstance(kind, K.StringType):
            raise TypeError("ids of this type aren't those of the index")
        docs = self.tables.docs.withColumn("found", F.lit(True)).drop("doc_ord")
        both = own.join(docs, own["id"] == docs["ext_id"], "left")
        return both.select("id", F.coalesce("found", F.lit(False)).alias("found"), *(["stored"] if "stored" in docs.columns else []))

    def dictionary(self) -> DataFrame:
        """(term, n_docs) of all terms, n_docs the most that one field has; in the order of their UTF-16 units."""
        return self.tables.terms.groupBy("term").agg(F.max("df").alias("n_docs")).orderBy(F.encode("term", "UTF-16BE"))

    def field_length(self, ident: Any, field: str) -> int:
        """Distinct tokens of a document's field; 0 where it has none or isn't there."""
        at = self._row(ident).select("doc_ord").join(self.tables.lengths.where(F.col("field_id") == self.options.fields.index(field)), "doc_ord").first()
        return (at["len"] if at else 0) or 0

    @staticmethod
    def duplicate_ids(documents: DataFrame, id_field: str = "id") -> DataFrame:
        """(id, count) of the ids that more than one row has; an index can't be built from those."""
        return duplicate_ids(documents, id_field)

    def get_stored_fields(self, ident: Any) -> dict[str, Any] | None:
        row = self._row(ident).first()
        if row is None:
            return None
        return row["stored"].asDict(recursive=True) if "stored" in row else {}

    def stats(self) -> DataFrame:
        """(component, rows) of each table."""
        parts = [(n, t) for n, t in (("documents", self.tables.docs), ("postings", self.tables.bare), ("terms", self.tables.terms), ("lengths", self.tables.lengths))]
        out = None
        for name, t in parts:
            one = t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("component"), "rows")
            out = one if out is None else out.unionByName(one)
        return out

    def faults(self) -> DataFrame:
        """(fault, n): what an index can't have, such as postings of no document. Empty if all is well."""
        t = self.tables
        name = lambda df, fault: df.select(F.lit(fault).alias("fault"), "n")
        wrong = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
        # What a row shows by itself is counted in one pass, and postings are counted by document before they meet the documents.
        alone = t.bare.agg(wrong(F.col("tf") < 1).alias("tf"), wrong((F.col("field_id") < 0) | (F.col("field_id") >= len(self.options.fields))).alias("field"))
        each = alone.select(F.explode(F.array(F.struct(F.lit("frequency below 1").alias("fault"), F.col("tf").alias("n")), F.struct(F.lit("field out of range").alias("fault"), F.col("field").alias("n")))).alias("x")).select("x.*")
        lost = t.bare.groupBy("doc_ord").agg(F.count("*").alias("n")).join(t.docs, "doc_ord", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        twice = t.terms.groupBy("term", "field_id").count().where("count > 1").agg(F.count("*").alias("n"))
        n = t.pieces()
        postings = t.postings.repartition(n, "term") if t.counted is None else t.postings
        unequal = postings.groupBy("term", "field_id").agg(F.count("*").alias("n"), F.max("df").alias("df")).where("n <> df").agg(F.count("*").alias("n"))
        return name(lost, "posting of no document").unionByName(each).unionByName(name(twice, "duplicate term")).unionByName(name(unequal, "document frequency")).where("n > 0")

    def save(self, path: str, compression: str = "auto") -> None:
        from .sources.store import save

        save(self, path, compression)

    @classmethod
    def load(cls, spark: SparkSession, path: str, options: IndexOptions | None = None) -> SearchIndex:
        from .sources.store import load

        return load(spark, path, options)

    def to_json(self) -> str:
        from .sources.snapshot import to_json

        return to_json(self)

    def save_json(self, path: str, compression: str = "none") -> None:
        """Write the JSON snapshot as a folder of text files, to be read one after another."""
        from .sources.snapshot import save_json

        save_json(self, path, compression)

    @classmethod
    def load_json(cls, spark: SparkSession, path: str, options: IndexOptions | None = None) -> SearchIndex:
        """Read the folder that ``save_json`` wrote, without its text going through the driver."""
        from .sources.snapshot import load_json

        return load_json(spark, path, options)

    @classmethod
    def from_json(cls, spark: SparkSession, text: str, options: IndexOptions | None = None) -> SearchIndex:
        from .sources.snapshot import from_json

        return from_json(spark, text, options)


class IndexBuilder:
    """Collects documents, then freezes once."""

    def __init__(self, spark: SparkSession, options: IndexOptions, estimated_document_count: int | None = None, estimated_postings_per_slot: int | None = None):
        self.spark, self.options = spark, options
        self._parts: list[DataFrame] = []
        #: Rows added one by one, with their schema; those of one schema become one DataFrame.
        self._rows: list[tuple[Any, list[Any]]] = []
        self._frozen = False

    def _open(self) -> None:
        if self._frozen:
            raise RuntimeError("the builder is frozen")

    def add(self, document: dict[str, Any], schema: Any = None) -> IndexBuilder:
        return self.add_all([document], schema)

    def add_all(self, documents: Any, schema: Any = None) -> IndexBuilder:
        """Add a DataFrame, or rows that are made into one."""
        self._open()
        if isinstance(documents, DataFrame):
            self._parts.append(documents)
            return self
        for known, rows in self._rows:
            if known == schema:
                rows.extend(documents)
                return self
        self._rows.append((schema, list(documents)))
        return self

    def add_all_in_chunks(self, documents: Any, chunk_size: int = 10, schema: Any = None) -> IndexBuilder:
        if not isinstance(chunk_size, int) or isinstance(chunk_size, bool) or chunk_size < 1:
            raise ValueError("chunk_size must be a positive integer")
        rows = list(documents)
        for lo in range(0, len(rows), chunk_size):
            self.add_all(rows[lo : lo + chunk_size], schema)
        return self

    def documents(self) -> DataFrame:
        parts = [*self._parts, *(self.spark.createDataFrame(rows, schema) for schema, rows in self._rows if rows)]
        if not parts:
            raise ValueError("no documents were added")
        out = parts[0]
        for df in parts[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out

    @property
    def document_count(self) -> int:
        return sum(df.count() for df in self._parts) + sum(len(rows) for _, rows in self._rows)

    def freeze(self) -> SearchIndex:
        self._open()
        self._frozen = True
        return SearchIndex.from_dataframe(self.documents(), self.options)


def create_builder(spark: SparkSession, options: IndexOptions, **hints: Any) -> IndexBuilder:
    return IndexBuilder(spark, options, **hints)


def build_from_documents(documents: DataFrame, options: IndexOptions) -> SearchIndex:
    return SearchIndex.from_dataframe(documents, options)
