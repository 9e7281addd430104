"""Line deduplication by sharded minimal perfect hashing.

The distinct lines of the corpus, as 128-bit hashes, are cut into shards. Each shard's keys get a minimal perfect hash
(levels of bit arrays; a key belongs to the first level where it has a bit alone, and its number is the rank of that
bit), which indexes compact arrays of fingerprints, counts and, for lines that repeat, the first occurrence. Lines of
documents, as hashes and positions only, stream past the arrays of their shard; texts of lines are never joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KA, KB, cut, mix64, select_in, with_key

#: Distinct lines of a shard, about; its arrays and the building of them take some 100 bytes a line at most.
SHARD_LINES = 250_000
#: Probes that one copy of a shard's arrays serves; shards with more occurrences are copied.
SHARD_PROBES = 4_000_000
#: Bits of a level for each key that is left.
GAMMA = 1.7

_U = np.uint64
_OWN = np.dtype([("a", "<i8"), ("b", "<i8"), ("pos", "<i4")])
_INDEX = "shard int, salt int, kind int, levels array<long>, bits binary, fingerprints binary, counts binary, repeats binary, h1 long, h2 long, ka long, kb long, pos int"


def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(h1.view(np.uint64) ^ mix64(h2.view(np.uint64) + _U(level * 0x9E3779B97F4A7C15 & (2**64 - 1)))) % _U(size)).astype(np.int64)


def build_mph(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and all levels' bits, for distinct keys (h1, h2)."""
    levels, bits = [], []
    while len(h1):
        size = max(1, int(len(h1) * GAMMA))
        at = _slot(h1, h2, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(size)
        bits.append(alone)
        left = ~alone[at]
        h1, h2 = h1[left], h2[left]
    return levels, np.concatenate(bits) if bits else np.zeros(0, bool)


def probe_mph(levels: list[int], bits: np.ndarray, ranks: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The number of each key; of a key that wasn't built in, that of some other key or -1."""
    out = np.full(len(h1), -1, np.int64)
    left, start = np.arange(len(h1)), 0
    for level, size in enumerate(levels):
        if not len(left):
            break
        at = _slot(h1[left], h2[left], level, size) + start
        hit = bits[at]
        out[left[hit]] = ranks[at[hit]]
        left, start = left[~hit], start + size
    return out


def fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mix64(h2.view(np.uint64) ^ mix64(h1.view(np.uint64))) >> _U(48)).astype(np.uint16)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = pdf["h1"].to_numpy(), pdf["h2"].to_numpy()
    levels, bits = build_mph(h1, h2)
    at = probe_mph(levels, bits, np.cumsum(bits) - 1, h1, h2)
    n = np.empty(len(at), np.uint32)
    n[at] = np.minimum(pdf["n"].to_numpy(), 2**32 - 1)
    fp = np.empty(len(at), np.uint16)
    fp[at] = fingerprint(h1, h2)
    # The first occurrences of those that repeat only, in the order of their numbers.
    order = np.empty(len(at), np.int64)
    order[at] = np.arange(len(at))
    order = order[n > 1]
    own = np.empty(len(order), _OWN)
    for field, col in (("a", "ka"), ("b", "kb"), ("pos", "pos")):
        own[field] = pdf[col].to_numpy()[order]
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "levels": [levels], "bits": [np.packbits(bits).tobytes()], "fingerprints": [fp.tobytes()], "counts": [n.tobytes()], "repeats": [own.tobytes()], "occurrences": [int(pdf["n"].sum())]})


class _Shard:
    def __init__(self, row: dict):
        self.levels = list(row["levels"])
        self.bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(self.levels)).astype(bool)
        self.ranks = np.cumsum(self.bits) - 1
        self.fp = np.frombuffer(row["fingerprints"], np.uint16)
        self.counts = np.frombuffer(row["counts"], np.uint32)
        self.repeats = np.frombuffer(row["repeats"], _OWN)
        self.repeat_no = np.cumsum(self.counts > 1) - 1

    def drops(self, h1: np.ndarray, h2: np.ndarray, a: np.ndarray, b: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Which occurrences aren't the first of their line."""
        at = probe_mph(self.levels, self.bits, self.ranks, h1, h2)
        known = np.flatnonzero(at >= 0)
        known = known[self.fp[at[known]] == fingerprint(h1[known], h2[known])]
        many = known[self.counts[at[known]] > 1]
        own = self.repeats[self.repeat_no[at[many]]]
        return many[(own["a"] != a[many]) | (own["b"] != b[many]) | (own["pos"] != pos[many])]


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard: _Shard | None = None
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        marks = np.concatenate([np.flatnonzero(kind == 0), [len(kind)]])
        if marks[0] > 0:
            spans = [(None, 0, marks[0])]
        else:
            spans = []
        spans += [(m, m + 1, n) for m, n in zip(marks[:-1], marks[1:], strict=True)]
        for mark, lo, hi in spans:
            if mark is not None:
                shard = _Shard({c: batch.column(c)[int(mark)].as_py() for c in ("levels", "bits", "fingerprints", "counts", "repeats")})
            if hi <= lo or shard is None:
                continue
            part = batch.slice(int(lo), int(hi - lo))
            h1, h2, a, b, pos = (part.column(c).to_numpy() for c in ("h1", "h2", "ka", "kb", "pos"))
            out = shard.drops(h1, h2, a, b, pos)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(a[out]), pa.array(b[out]), pa.array(pos[out])], [KA, KB, "pos"])


def occurrences(keyed: DataFrame) -> DataFrame:
    """(id, key, pos, h1, h2) of every line that isn't blank; a line is compared without white space at its ends."""
    lines = keyed.where("text is not null").select("id", KA, KB, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = lines.select("id", KA, KB, "pos", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", "").alias("line")).where("line <> ''")
    return bare.select("id", KA, KB, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(104729), "line").alias("h2"))


def line_index(occ: DataFrame) -> DataFrame:
    """One row for each shard with its arrays, in the shared folder."""
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", F.col(KA).alias("a"), F.col(KB).alias("b"), "pos"))
    distinct = cut(occ.groupBy("h1", "h2").agg(F.count("*").alias("n"), first.alias("own")).select("h1", "h2", "n", F.col("own.a").alias("ka"), F.col("own.b").alias("kb"), F.col("own.pos").alias("pos")))
    shards = max(1, -(-distinct.count() // SHARD_LINES))
    sharded = distinct.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    index = sharded.groupBy("shard").applyInPandas(_build, "shard int, levels array<long>, bits binary, fingerprints binary, counts binary, repeats binary, occurrences long")
    return cut(index.withColumn("shards", F.lit(shards)))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, positions): the lines of each document that aren't the first of their kind."""
    occ = occurrences(select_in(docs, id_col, text_col))
    index = line_index(occ)
    head = index.agg(F.max("shards"), F.max("occurrences")).first()
    shards = head[0] or 1
    none = lambda kind: F.lit(None).cast(kind)
    zero = F.lit(0).cast("long")
    probes = occ.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    copies = F.ceil(F.col("occurrences") / SHARD_PROBES).cast("int")
    if (head[1] or 0) > SHARD_PROBES:
        # Hot shards are copied, and their probes spread over the copies. Spark broadcasts the numbers if they are few.
        hot = index.where(F.col("occurrences") > SHARD_PROBES).select("shard", copies.alias("copies"))
        probes = probes.join(hot, "shard", "left").withColumn("salt", F.pmod(F.col(KB), F.coalesce("copies", F.lit(1))).cast("int"))
    else:
        probes = probes.withColumn("salt", F.lit(0))
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), F.lit(0).alias("kind"), "levels", "bits", "fingerprints", "counts", "repeats", zero.alias("h1"), zero.alias("h2"), zero.alias("ka"), zero.alias("kb"), F.lit(0).alias("pos"))
    feed = arrays.unionByName(
        probes.select("shard", "salt", F.lit(1).alias("kind"), none("array<long>").alias("levels"), *[none("binary").alias(c) for c in ("bits", "fingerprints", "counts", "repeats")], "h1", "h2", F.col(KA).alias("ka"), F.col(KB).alias("kb"), "pos")
    )
    dropped = feed.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(_probe, f"{KA} long, {KB} long, pos int")
    return dropped.groupBy(KA, KB).agg(F.collect_set("pos").alias("_sq_drop"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", count_col: str | None = None) -> DataFrame:
    """``docs`` with each line kept only where it first occurs in the corpus.

    Occurrences are ordered by id (nulls last), key of (id, text) and position in the text. Lines are compared without
    blanks at their ends; lines that are blank stay. A document that had lines and loses all of them that aren't blank
    goes; null and blank texts stay as they are. Rows repeated whole have the same occurrences, so they keep equal
    texts. ``length_col``, if there is such a column, gets the new length; other columns are left alone. ``count_col``
    names a column to be added with the number of lines dropped. Texts are taken whole, whatever their length. An empty
    table gives no rows. Ids may be of any type that has an order.
    """
    drops = repeats(docs, id_col, text_col).withColumnsRenamed({KA: "_sq_da", KB: "_sq_db"})
    own = with_key(docs, id_col, text_col)
    both = own.join(drops, (own[KA] == drops["_sq_da"]) & (own[KB] == drops["_sq_db"]), "left")
    text = F.col(f"`{text_col}`")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("_sq_drop", i)), "\n")
    done = both.withColumn("_sq_text", F.when(F.col("_sq_drop").isNull(), text).otherwise(kept))
    done = done.where(F.col("_sq_drop").isNull() | F.col("_sq_text").rlike(r"[^ \t\r\n]"))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("_sq_text").alias(c))
        elif c == length_col:
            cols.append(F.when(F.col("_sq_drop").isNull(), F.col(f"`{c}`")).otherwise(F.length("_sq_text")).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    if count_col:
        cols.append(F.coalesce(F.size("_sq_drop"), F.lit(0)).alias(count_col))
    return done.select(*cols)
