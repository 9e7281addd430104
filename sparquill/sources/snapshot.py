"""JSON snapshots of an index, in the format of versions 1 and 2 of the common interchange form.

A snapshot is one JSON text. ``to_json`` and ``from_json`` put it together and take it apart on the driver, for small
indexes. ``save_json`` writes it in parts that are made where the data lie, and ``load_json`` reads such parts where they
lie, so neither the text nor what it holds goes through the driver.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import IndexOptions, Tables, pieces, with_df, with_ordinal
from .store import cut, release


def to_json(index: Any) -> str:
    t, o = index.tables, index.options
    stored = "stored" in t.docs.columns
    docs = [r.asDict(recursive=True) for r in t.docs.orderBy("doc_ord").collect()]
    short = {d["doc_ord"]: str(i) for i, d in enumerate(docs)}
    lengths: dict[str, list[int]] = {i: [0] * len(o.fields) for i in short.values()}
    for r in t.lengths.collect():
        lengths[short[r["doc_ord"]]][r["field_id"]] = r["len"] or 0
    one = F.map_from_entries(F.sort_array(F.collect_list(F.struct("doc_ord", "tf"))))
    per_field = t.postings.groupBy("term", "field_id").agg(one.alias("docs"))
    rows = per_field.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("field_id", F.to_json("docs").alias("docs")))).alias("f")).orderBy(F.encode("term", "UTF-16BE")).collect()
    entries = [[r["term"], {str(f["field_id"]): {short[int(k)]: v for k, v in json.loads(f["docs"]).items()} for f in r["f"]}] for r in rows]
    return json.dumps(
        {
            "documentCount": t.count, "nextId": t.count, "documentIds": {short[d["doc_ord"]]: d["ext_id"] for d in docs}, "fieldIds": {f: i for i, f in enumerate(o.fields)},
            "fieldLength": lengths, "averageFieldLength": list(t.averages), "storedFields": {short[d["doc_ord"]]: d["stored"] for d in docs} if stored else {},
            "dirtCount": 0, "index": entries, "serializationVersion": 2,
        },
        ensure_ascii=False, default=str,
    )


#: Documents whose numbers are broadcast at most.
FEW = 200_000


def _by_document(postings: DataFrame, docs: DataFrame, count: int, n: int, on: list[str]) -> DataFrame:
    """Postings joined with a table by document, in ``n`` partitions whose tasks hold that table's rows, not the postings."""
    if count <= FEW:
        return postings.join(F.broadcast(docs), on)
    return postings.repartition(n, "doc_ord").join(docs.repartition(n, "doc_ord").hint("shuffle_hash"), on)


def _entries(least: str | None) -> Any:
    """Lines of the index out of (term, field_id, short, tf) sorted so, with all postings of a term in one partition.

    A line holds the postings of a field of a term that come in one batch. What it opens is closed by the next line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, field = None, None
        for b in batches:
            if not b.num_rows:
                continue
            terms, fields = b.column("term").dictionary_encode(), b.column("field_id").to_numpy()
            codes = terms.indices.to_numpy()
            entry = pc.binary_join_element_wise('"', b.column("short").cast(pa.string()), '": ', b.column("tf").cast(pa.string()), "")
            cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (fields[1:] != fields[:-1])) + 1
            ends = np.concatenate([[0], cuts, [b.num_rows]]).astype(np.int32)
            bodies = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), entry), ",").to_pylist()
            lines = []
            for at, body in zip(ends[:-1], bodies, strict=True):
                t, f = terms.dictionary[codes[at]].as_py(), int(fields[at])
                if t != term:
                    lines.append(f'{"" if term is None else "}}]"}{"" if t == least else ","}[{json.dumps(t, ensure_ascii=False)}, {{"{f}": {{{body}')
                elif f != field:
                    lines.append(f'}}, "{f}": {{{body}')
                else:
                    lines.append("," + body)
                term, field = t, f
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["line"])
        if term is not None:
            yield pa.RecordBatch.from_arrays([pa.array(["}}]"])], ["line"])

    return run


def save_json(index: Any, path: str, compression: str = "none") -> None:
    """Write the snapshot that ``to_json`` makes as a folder of text files, which one after another are its JSON text.

    Each document is a line of its own, and postings are lines of some thousands at most, so nothing goes through the
    driver. Postings are sorted in partitions of bounded size, but that those of a term lie in one.
    """
    t, o = index.tables, index.options
    stored = "stored" in t.docs.columns
    n = t.pieces()
    ends = t.docs.agg(F.min("doc_ord").alias("low"), F.max("doc_ord").alias("high"), F.count("*").alias("n")).first()
    # Consecutive numbers need only be shifted; others are looked up.
    shift = t.count and ends["n"] == t.count and ends["high"] - ends["low"] + 1 == t.count
    near = lambda df: df.withColumn("short", F.col("doc_ord") - F.lit(ends["low"]))
    docs = cut(near(t.docs) if shift else with_ordinal(t.docs, F.col("doc_ord"), F.col("doc_ord"), "short"))
    short = docs.select("doc_ord", "short")
    # At least two, as Spark merges the members of a union that have one partition each.
    least_parts = max(2, t.docs.sparkSession.sparkContext.defaultParallelism)
    parts = max(least_parts, pieces(t.count))

    def value(c: Column) -> Column:
        """JSON of a value, out of that of a list of it."""
        text = F.to_json(F.array(c), {"ignoreNullFields": "false"})
        return F.substring(text, F.lit(2), F.length(text) - 2)

    def lines(df: DataFrame, v: Column) -> DataFrame:
        """A line for each document, in their order."""
        line = F.concat(F.when(F.col("short") == 0, F.lit("")).otherwise(F.lit(",")), F.lit('"'), F.col("short").cast("string"), F.lit('":'), v)
        return df.select("short", line.alias("line")).repartitionByRange(parts, "short").sortWithinPartitions("short").select("line")

    def fixed(text: str) -> DataFrame:
        return t.docs.sparkSession.range(1, numPartitions=1).select(F.lit(text).alias("line"))

    head = json.dumps({"documentCount": t.count, "nextId": t.count, "fieldIds": {f: i for i, f in enumerate(o.fields)}, "averageFieldLength": list(t.averages), "dirtCount": 0, "serializationVersion": 2})
    lengths = t.lengths.groupBy("doc_ord").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("field_id", F.coalesce("len", F.lit(0)).alias("len")))), lambda x: x["len"])).alias("l"))
    lengths = near(lengths) if shift else lengths.join(short, "doc_ord")
    key = F.encode("term", "UTF-16BE")
    least = t.bare.agg(F.min(key).alias("k")).select(F.decode("k", "UTF-16BE").alias("k")).first()["k"]
    posted = t.bare.select("term", "field_id", "doc_ord", "tf")
    posted = near(posted) if shift else _by_document(posted, short, t.count, n, ["doc_ord"])
    # By the term alone, so that a term's lines follow each other in one partition.
    posted = posted.withColumn("key", key).repartitionByRange(max(least_parts, pieces(t.size)), "key").sortWithinPartitions("key", "field_id", "short")
    # The parts of a union are written in its order.
    sections = [
        fixed(head[:-1] + ', "documentIds": {'), lines(docs, value(F.col("ext_id"))),
        fixed('}, "fieldLength": {'), lines(lengths, F.col("l")),
        fixed('}, "storedFields": {'), *([lines(docs, value(F.col("stored")))] if stored else []),
        fixed('}, "index": ['), posted.select("term", "field_id", "short", "tf").mapInArrow(_entries(least), "line string"),
        fixed("]}"),
    ]
    reduce(DataFrame.unionByName, sections).write.mode("overwrite").option("compression", compression).text(path)
    release(docs)


class SnapshotError(ValueError):
    pass


def _object(x: Any, what: str) -> dict[str, Any]:
    if not isinstance(x, dict):
        raise SnapshotError(f"{what} must be an object")
    return x


def _whole(x: Any, what: str) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x < 0:
        raise SnapshotError(f"{what} must be a non-negative integer")
    return x


def _key(x: str, what: str, below: int, of: str) -> int:
    if not (x.isascii() and x.isdigit()) or len(x) > 1 and x[0] == "0":
        raise SnapshotError(f'{what} key "{x}" must be a non-negative integer')
    if int(x) >= below:
        raise SnapshotError(f"{what} {x} must be < {of} {below}")
    return int(x)


def _head(s: dict[str, Any], options: IndexOptions | None) -> tuple[int, dict[str, int], list[float], int, int]:
    """(version, fields' numbers, averages, number of documents, next number) of a snapshot."""
    version = _whole(s.get("serializationVersion"), "serializationVersion")
    if version not in (1, 2):
        raise SnapshotError(f"unsupported serializationVersion {version}")
    names, averages = _object(s.get("fieldIds"), "fieldIds"), s.get("averageFieldLength")
    if not isinstance(averages, list):
        raise SnapshotError("averageFieldLength must be an array")
    if options is not None and set(options.fields) != set(names):
        raise SnapshotError("the options' fields differ from those of the snapshot")
    width = len(names)
    for f, i in names.items():
        if _whole(i, f"fieldIds.{f}") >= width:
            raise SnapshotError(f"fieldIds.{f} must be < field count {width}")
    if len(set(names.values())) != width:
        raise SnapshotError("a field id is assigned more than once")
    if len(averages) != width or any(isinstance(a, bool) or not isinstance(a, (int, float)) or not math.isfinite(a) or a < 0 for a in averages):
        raise SnapshotError(f"averageFieldLength must hold {width} non-negative numbers")
    count, next_id = _whole(s.get("documentCount"), "documentCount"), _whole(s.get("nextId"), "nextId")
    if count > next_id:
        raise SnapshotError(f"documentCount {count} must be <= nextId {next_id}")
    return version, names, averages, count, next_id


def from_json(spark: SparkSession, text: str, options: IndexOptions | None = None) -> Any:
    """Read a snapshot. Short ids are made dense if some are missing, and postings of documents that are gone are left out."""
    from ..index import SearchIndex

    s = _object(json.loads(text), "snapshot")
    version, names, averages, count, next_id = _head(s, options)
    width = len(names)
    ids = _object(s.get("documentIds"), "documentIds")
    lengths, stored = _object(s.get("fieldLength"), "fieldLength"), _object(s.get("storedFields"), "storedFields")
    if not isinstance(s.get("index"), list):
        raise SnapshotError("index must be an array")
    active = sorted(_key(k, "documentIds shortId", next_id, "nextId") for k in ids)
    if len(active) > count:
        raise SnapshotError(f"documentIds count {len(active)} must be <= documentCount {count}")
    for what, rows in (("storedFields", stored), ("fieldLength", lengths)):
        for k in rows:
            if _key(k, f"{what} shortId", next_id, "nextId") not in set(active):
                raise SnapshotError(f"{what} shortId {k} is missing from documentIds")
    if len(lengths) != len(active):
        raise SnapshotError(f"fieldLength must cover all {len(active)} active documents (got {len(lengths)})")
    dense = {k: i for i, k in enumerate(active)} if count < next_id else {k: k for k in active}
    for k, row in lengths.items():
        if not isinstance(row, list) or any(x is not None and (isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x < 0) for x in row):
            raise SnapshotError(f"fieldLength shortId {k} must be an array of non-negative numbers")
    length = {dense[int(k)]: [(row[f] if f < len(row) else 0) or 0 for f in range(width)] for k, row in lengths.items()}
    seen: set[str] = set()
    postings, terms = [], []
    for n, entry in enumerate(s["index"]):
        if not isinstance(entry, list) or len(entry) != 2:
            raise SnapshotError(f"index entry {n} must be a [term, data] pair")
        term, data = entry
        if not isinstance(term, str):
            raise SnapshotError(f"index entry {n} term must be a string")
        if term in seen:
            raise SnapshotError(f'index term "{term}" is duplicated')
        seen.add(term)
        for f, docs in _object(data, f'index term "{term}"').items():
            field = _key(f, f'index term "{term}" fieldId', width, "field count")
            if version == 1 and isinstance(docs, dict) and "ds" in docs:
                docs = docs["ds"]
            own = []
            for k, tf in _object(docs, f'index term "{term}" field {f}').items():
                at = _key(k, f'index term "{term}" field {f} shortId', next_id, "nextId")
                if _whole(tf, f'index term "{term}" field {f} frequency') == 0:
                    raise SnapshotError(f'index term "{term}" field {f} frequency must be a positive integer')
                if at in dense:
                    own.append((dense[at], min(tf, 65535)))
            postings += [(term, field, d, tf, int(length[d][field]), len(own)) for d, tf in own]
            terms += [(term, field, len(own))] if own else []
    o = _options(names, options, sorted({f for row in stored.values() for f in (row or {})}))
    keep = o.store_fields
    values = list(ids.values())
    kind = "string" if all(isinstance(v, str) for v in values) else "long" if all(isinstance(v, int) and not isinstance(v, bool) for v in values) else "double" if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values) else None
    if kind is None:
        raise SnapshotError("document ids must be all strings or all numbers")
    rows = [(dense[k], float(ids[str(k)]) if kind == "double" else ids[str(k)], *[json.dumps((stored.get(str(k)) or {}).get(f), ensure_ascii=False) for f in keep]) for k in active]
    docs = spark.createDataFrame(rows, ", ".join(["doc_ord long", f"ext_id {kind}", *[f"`s_{i}` string" for i in range(len(keep))]]))
    if keep:
        # Stored values come as their own types where a field has one only.
        typed = []
        for i, f in enumerate(keep):
            found = [(stored.get(str(k)) or {}).get(f) for k in active]
            schema = _type_of([v for v in found if v is not None])
            typed.append(F.get_json_object(F.concat(F.lit('{"v":'), F.col(f"s_{i}"), F.lit("}")), "$.v").cast(schema).alias(f) if schema in ("string", "long", "double", "boolean") else F.from_json(f"s_{i}", schema).alias(f))
        docs = docs.select("doc_ord", "ext_id", F.struct(*typed).alias("stored"))
    p = spark.createDataFrame(postings, "term string, field_id int, doc_ord long, tf int, len int, df long")
    t = spark.createDataFrame(terms, "term string, field_id int, df long")
    every = spark.createDataFrame([(d, f, int(v)) for d, row in length.items() for f, v in enumerate(row)], "doc_ord long, field_id int, len int")
    return SearchIndex(Tables(docs, p, t, every, tuple(float(np.float32(a)) for a in averages), count), o)


def _options(names: dict[str, int], options: IndexOptions | None, stored: list[str]) -> IndexOptions:
    """The index's options: the snapshot's fields in its order, and the stored ones that are asked for or there."""
    base = options.__dict__ if options is not None else {}
    keep = options.store_fields if options is not None and options.store_fields else tuple(stored)
    return IndexOptions(**{**base, "fields": tuple(sorted(names, key=lambda f: names[f])), "store_fields": tuple(keep)})


def _type_of(values: list[Any]) -> str:
    if all(isinstance(v, bool) for v in values) and values:
        return "boolean"
    if values and all(isinstance(v, int) and not isinstance(v, bool) for v in values):
        return "long"
    if values and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        return "double"
    if values and all(isinstance(v, list) for v in values):
        inner = _type_of([x for v in values for x in v])
        return f"array<{inner}>" if inner in ("string", "long", "double", "boolean") else "array<string>"
    return "string"


#: Characters of postings that are taken apart at a time.
TEXT = 1_000_000
#: Kinds of rows that lines give.
HEAD, ID, LENGTH, STORED, POSTING, TERM, LAST, TYPES = range(8)
_ROWS = "kind int, file string, start long, short long, field int, term string, tf long, value string"
_SCHEMA = pa.schema([("kind", pa.int32()), ("file", pa.string()), ("start", pa.int64()), ("short", pa.int64()), ("field", pa.int32()), ("term", pa.string()), ("tf", pa.int64()), ("value", pa.string())])
_DOCUMENT, _FIELD, _OPEN = re.compile(r',?"([0-9]+)":(?=[^ ])'), re.compile(r'\}, "([0-9]+)": \{'), re.compile(r"(?:\}\}\])?,?\[(?=\")")
_FIRST, _MORE = re.compile(r', \{"([0-9]+)": \{'), re.compile(r',(?="[0-9]+": )')


def _tag(v: Any) -> str | list[str]:
    """The kind of a stored value; of a list, those of its items."""
    return sorted({str(_tag(x)) for x in v}) if isinstance(v, list) else "b" if isinstance(v, bool) else "l" if isinstance(v, int) else "d" if isinstance(v, float) else "s"


_SAMPLES: dict[str, Any] = {"b": True, "l": 1, "d": 1.5, "s": ""}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the lines of blocks of files. Postings before a block's first term, or field, have none; its last ones are told."""
    block, term, field = None, None, None
    types: dict[str, set[str]] = {}
    decode = json.JSONDecoder().raw_decode

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    def postings(held: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([x[4].count('": ') for x in held])
        text = ",".join(x[4] for x in held).replace('": ', ",").replace('"', "")
        if not re.fullmatch(r"[0-9]{1,18}(?:,[0-9]{1,18})*", text):
            raise SnapshotError("a short id or frequency isn't a whole number")
        numbers = np.fromstring(text, dtype=np.int64, sep=",")
        if len(numbers) != 2 * sizes.sum():
            raise SnapshotError("postings aren't pairs of numbers")
        which = pa.array(np.repeat(np.arange(len(held)), sizes))
        own = [pa.array(c, f).take(which) for c, f in zip(zip(*(x[:4] for x in held), strict=True), (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)]
        n = len(which)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, POSTING, np.int32)), own[0], own[1], pa.array(numbers[::2]), own[2], own[3], pa.array(numbers[1::2]), pa.nulls(n, pa.string())], schema=_SCHEMA)

    for b in batches:
        out: list[tuple] = []
        held: list[tuple] = []
        size = 0
        for line, *at in zip(*(b.column(c).to_pylist() for c in ("value", "file", "start")), strict=True):
            if at != block:
                if block is not None:
                    out.append((LAST, *block, None, field, term, None, None))
                block, term, field = at, None, None
            body = None
            if m := _MORE.match(line):
                body = line[m.end() :]
            elif m := _DOCUMENT.match(line):
                v = line[m.end() :]
                if len(m[1]) > 1 and m[1][0] == "0":
                    raise SnapshotError(f'shortId "{m[1]}" must be a non-negative integer')
                if v[0] == "[":
                    out.append((LENGTH, *at, int(m[1]), None, None, None, v))
                elif v[0] == "{":
                    for k, x in json.loads(v).items():
                        types.setdefault(k, set()).update([] if x is None else [json.dumps(_tag(x))])
                    out.append((STORED, *at, int(m[1]), None, None, None, v))
                else:
                    x = json.loads(v)
                    kind = "sld".find(_tag(x)) if x is not None else -1
                    out.append((ID, *at, int(m[1]), kind, None, None, x if kind == 0 else v))
            elif m := _OPEN.match(line):
                term, end = decode(line, m.end())
                first = _FIRST.match(line, end)
                if not first:
                    raise SnapshotError("a term without a field")
                field, body = int(first[1]), line[first.end() :]
                out.append((TERM, *at, None, None, term, None, None))
            elif m := _FIELD.match(line):
                field, body = int(m[1]), line[m.end() :]
            elif line.startswith('{"documentCount"') and line.endswith(', "documentIds": {'):
                out.append((HEAD, *at, None, None, None, None, line[: -len(', "documentIds": {')] + "}"))
            elif line not in ('}, "fieldLength": {', '}, "storedFields": {', '}, "index": [', "}}]", "]}"):
                raise SnapshotError("a line that isn't of a snapshot in parts")
            if body is not None:
                held.append((*at, field, term, body))
                size += len(body)
                if size > TEXT:
                    yield postings(held)
                    held, size = [], 0
        if out:
            yield rows(out)
        if held:
            yield postings(held)
    if block is not None:
        yield rows([(LAST, *block, None, field, term, None, None), (TYPES, *block, None, None, None, None, json.dumps({k: sorted(v) for k, v in types.items()}))])


def load_json(spark: SparkSession, path: str, options: IndexOptions | None = None) -> Any:
    """Read the folder that ``save_json`` wrote, line by line where the files lie.

    A block of a file may start amid a term's postings; these get the term that the blocks before it end with. Only
    that, and what the whole index has once, is seen by the driver. Other texts are for ``from_json``.
    """
    from ..index import SearchIndex

    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = cut(read.mapInArrow(_parse, _ROWS))
    of = lambda kind: rows.where(F.col("kind") == kind)
    heads = of(HEAD).limit(2).collect()
    if len(heads) != 1:
        raise SnapshotError("a snapshot in parts has one head")
    _, names, averages, count, next_id = _head(json.loads(heads[0]["value"]), options)
    width = len(names)
    # Of a block the term and field that it starts with.
    carried, term, field = [], None, None
    for r in sorted(of(LAST).collect(), key=lambda r: (r["file"], r["start"])):
        carried.append((r["file"], r["start"], term, field))
        term, field = r["term"] if r["term"] is not None else term, r["field"] if r["field"] is not None else field
    carry = spark.createDataFrame(carried, "file string, start long, last_term string, last_field int")
    posts = of(POSTING).join(F.broadcast(carry), ["file", "start"]).select(F.coalesce("term", "last_term").alias("term"), F.coalesce("field", "last_field").alias("field_id"), F.col("short").alias("doc_ord"), "tf")
    seen = rows.where(F.col("kind").isin(ID, LENGTH, STORED)).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("short").alias("ids"), F.max("short").alias("most"), F.min("field").alias("least_type"), F.max("field").alias("most_type"))
    facts = {r["kind"]: r for r in seen.collect()}
    for kind, what in ((ID, "documentIds"), (LENGTH, "fieldLength"), (STORED, "storedFields")):
        r = facts.get(kind)
        if r and (r["ids"] < r["n"] or r["most"] >= next_id):
            raise SnapshotError(f"{what} has a shortId twice, or one that isn't < nextId {next_id}")
        if kind != STORED and (r["n"] if r else 0) != next_id or count != next_id:
            raise SnapshotError(f"{what} must cover all {next_id} documents of a snapshot in parts")
    kinds = (facts[ID]["least_type"], facts[ID]["most_type"]) if count else (0, 0)
    if kinds[0] < 0 or kinds[0] == 0 < kinds[1]:
        raise SnapshotError("document ids must be all strings or all numbers")
    sums = posts.agg(F.count("*").alias("n"), F.max("doc_ord").alias("most"), F.max("field_id").alias("field"), F.min("tf").alias("tf"), F.count("term").alias("terms")).first()
    if sums["n"] and (sums["most"] >= next_id or sums["field"] >= width or sums["tf"] < 1 or sums["terms"] < sums["n"]):
        raise SnapshotError("a posting has no term, a document or field that isn't there, or a frequency that isn't positive")
    n = pieces(sums["n"])
    if (twice := of(TERM).select("term").repartition(n, "term").groupBy("term").count().where("count > 1").first()) is not None:
        raise SnapshotError(f'index term "{twice["term"]}" is duplicated')
    each = of(LENGTH).select(F.col("short").alias("doc_ord"), F.from_json("value", "array<double>").alias("v"))
    if each.where(F.col("v").isNull() | F.exists("v", lambda x: ~F.coalesce((x >= 0) & (x < float("inf")), F.lit(True)))).limit(1).count():
        raise SnapshotError("fieldLength must hold arrays of non-negative numbers")
    lengths = each.select("doc_ord", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("v", i), F.lit(0.0)).cast("int"))).alias("field_id", "len"))
    types: dict[str, set[str]] = {}
    for r in of(TYPES).select("value").distinct().collect():
        for k, tags in json.loads(r["value"]).items():
            types.setdefault(k, set()).update(tags)
    o = _options(names, options, sorted(types))
    docs = of(ID).select(F.col("short").alias("doc_ord"), F.col("value").cast(("string", "long", "double")[kinds[1]]).alias("ext_id"))
    if o.store_fields:
        # Lists of the kinds that were met stand for the values.
        sample = lambda tag: [sample(x) if x in _SAMPLES else {} for x in tag] if isinstance(tag, list) else _SAMPLES[tag]
        schema = ", ".join(f"`{f}` {_type_of([sample(json.loads(x)) for x in types.get(f, ())])}" for f in o.store_fields)
        said = of(STORED).select(F.col("short").alias("doc_ord"), "value")
        docs = docs.join(said, "doc_ord", "left").select("doc_ord", "ext_id", F.from_json(F.coalesce("value", F.lit("{}")), schema).alias("stored"))
    k = pieces(sums["n"], most=200)
    posts = posts.withColumn("tf", F.least("tf", F.lit(65535)).cast("int"))
    terms = cut(posts.select("term", "field_id").repartition(k, "term").groupBy("term", "field_id").agg(F.count("*").alias("df")))
    counted = _by_document(posts, lengths, count * width, k, ["doc_ord", "field_id"]).select("term", "field_id", "doc_ord", "tf", "len")
    return SearchIndex(Tables(docs, with_df(counted, terms.repartition(k, "term"), k), terms, lengths, tuple(float(np.float32(a)) for a in averages), count, counted, sums["n"], True), o)
