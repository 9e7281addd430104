"""Benchmark decontamination by greedy string tiling.

Runs of ``MIN_MATCH`` words of the benchmark items are seeds. A running hash over the words of a document finds the
seeds that it has (Karp-Rabin), and a join on the hash brings documents and items together. Pairs whose shared seeds
could cover enough of the item are tiled word by word: the longest matches without marked words are marked, again and
again, until none of ``MIN_MATCH`` words is left. The tiles may stand in any order, so reordered passages count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KA, KB, WORD, chunked, cut, lists, mix64, release, select_in, small_side, type_of, with_key

MIN_MATCH = 4
COVERAGE = 0.6
#: Hashes of seeds, eight bytes each, that are sent to the workers to sift documents; of a larger benchmark all windows go
#: to the join.
SIFTED_SEEDS = 4_000_000

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def rolling(words: list[str], k: int, hashes: dict[str, int]) -> np.ndarray:
    """Hash of each window of k words."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    x = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(hashes) > 500_000:
        hashes.clear()
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * _P + x[j : j + m]
    return mix64(h)


def tile(doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (doc position, item position, length) of two arrays of word numbers; those below 0 match nothing.

    Of matches of one length, that of the lower item position is marked first, then of the lower document position.
    """
    n, m = len(doc), len(item)
    if n < k or m < k:
        return []
    # Seeds: places of equal windows. Windows are numbered by their words, so equal numbers are equal words.
    both = np.concatenate([doc, item]).astype(np.int64)
    number = np.zeros(n + m, np.int64)
    for j in range(k):
        # Windows across the end of the document, or of the item, get numbers too, but aren't looked at.
        step = np.concatenate([both[j:], np.full(j, -2)])
        _, number = np.unique(number * (both.max() + 3) + step + 2, return_inverse=True)
    known = np.concatenate([[0], np.cumsum(doc < 0)])
    at_doc = np.flatnonzero(known[k:] == known[:-k])
    of_doc, of_item = number[at_doc], number[n : n + m - k + 1]
    order = np.argsort(of_item, kind="stable")
    lo, hi = np.searchsorted(of_item[order], of_doc, "left"), np.searchsorted(of_item[order], of_doc, "right")
    many = hi - lo
    d = np.repeat(at_doc, many)
    i = order[np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))]
    # Seeds one after another on a diagonal are one match.
    order = np.lexsort((i, d - i))
    d, i = d[order], i[order]
    used_doc, used_item = np.zeros(n + 1, np.int64), np.zeros(m + 1, np.int64)
    tiles = []
    while len(d):
        cut_ = np.flatnonzero((d[1:] - i[1:] != d[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)) + 1
        first = np.concatenate([[0], cut_])
        length = np.diff(np.append(first, len(d))) + k - 1
        best = int(length.max())
        at = first[length == best]
        for s in at[np.lexsort((d[at], i[at]))].tolist():
            x, y = int(d[s]), int(i[s])
            if not used_doc[x : x + best].any() and not used_item[y : y + best].any():
                used_doc[x : x + best] = 1
                used_item[y : y + best] = 1
                tiles.append((x, y, best))
        marks_doc, marks_item = np.concatenate([[0], np.cumsum(used_doc)]), np.concatenate([[0], np.cumsum(used_item)])
        free = (marks_doc[d + k] == marks_doc[d]) & (marks_item[i + k] == marks_item[i])
        d, i = d[free], i[free]
    return tiles


def item_seeds(items: DataFrame, k: int) -> DataFrame:
    """(h, iid, words, places): the distinct windows of each item, and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for iid, text in zip(batch.column("iid").to_pylist(), batch.column("itext").to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                h = rolling(words, k, hashes)
                if not len(h):
                    continue
                order = np.argsort(h, kind="stable")
                _, n = np.unique(h, return_counts=True)
                first = h[order][np.concatenate([[0], np.cumsum(n)[:-1]])]
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array([iid] * len(n), pa.int64()), pa.array([len(words)] * len(n), pa.int32()), lists(order.astype(np.int32), n, pa.int32())], ["h", "iid", "words", "places"])

    return items.mapInArrow(run, "h long, iid long, words int, places array<int>")


def _sieve(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and a bit table by which most others are told without a search."""
    bits = max(10, int(np.ceil(np.log2(max(1, len(hashes))))) + 4)
    bloom = np.zeros(1 << bits, bool)
    bloom[(hashes >> _U(64 - bits)).astype(np.int64)] = True
    return np.sort(hashes), bloom


def document_windows(src: DataFrame, k: int, seeds: DataFrame) -> DataFrame:
    """(key, h): the distinct windows of each document that are seeds, or all of them if there are very many seeds."""
    distinct = seeds.select("h").distinct()
    sent = None
    if distinct.limit(SIFTED_SEEDS + 1).count() <= SIFTED_SEEDS:
        sent = src.sparkSession.sparkContext.broadcast(_sieve(distinct.toArrow().column("h").to_numpy().view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for part in chunked(batches, "text", 2_000_000):
            found, n = [], []
            for text in part.column("text").to_pylist():
                h = rolling(WORD.findall(text.lower()), k, hashes)
                if sent is not None and len(h):
                    known, bloom = sent.value
                    h = h[bloom[(h >> _U(65 - len(bloom).bit_length())).astype(np.int64)]]
                    if len(known):
                        h = h[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
                h = np.unique(h)
                found.append(h)
                n.append(len(h))
            at = pa.array(np.repeat(np.arange(len(n)), n))
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(KA).take(at), part.column(KB).take(at), pa.array(flat.view(np.int64))], [KA, KB, "h"])

    return src.select(KA, KB, "text").mapInArrow(run, f"{KA} long, {KB} long, h long")


def _tiles(k: int, least: float, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, share, count = [], [], []
            for n in range(batch.num_rows):
                own = WORD.findall(batch.column("itext")[n].as_py().lower())
                number: dict[str, int] = {}
                item = np.array([number.setdefault(w, len(number)) for w in own], np.int64)
                get = number.get
                doc = np.array([get(w, -1) for w in WORD.findall(batch.column("text")[n].as_py().lower())], np.int64)
                tiles = tile(doc, item, k)
                covered = sum(t[2] for t in tiles) / len(own)
                if covered >= least:
                    at.append(n)
                    share.append(covered)
                    count.append(len(tiles))
            kept = batch.select(columns).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(share, pa.float64()), pa.array(count, pa.int32())], [*columns, "coverage", "tiles"])

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, key, item_id, coverage, tiles) for each distinct row and item that the row's tiles cover to ``coverage`` of its words."""
    src = select_in(docs, id_col, text_col).where("text is not null")
    rows = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("itext")).where("item_id is not null and itext is not null").distinct()
    items = cut(rows.withColumn("iid", F.monotonically_increasing_id()))
    seeds = cut(item_seeds(items.select("iid", "itext"), min_match))
    met = document_windows(src, min_match, seeds).join(small_side(seeds), "h")
    # Tiles lie within shared seeds, so these bound what tiling can reach. A place is there once, however often it is met.
    shared = met.groupBy(KA, KB, "iid").agg(F.first("words").alias("words"), F.flatten(F.collect_set("places")).alias("places"))
    reach = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (min_match - 1))))))
    pairs = cut(shared.where(reach >= F.lit(float(coverage)) * F.col("words")).select(KA, KB, "iid"))
    texts = src.join(small_side(cut(pairs.select(KA, KB).distinct())), [KA, KB], "left_semi").dropDuplicates([KA, KB])
    feed = texts.join(small_side(pairs), [KA, KB]).join(small_side(items), "iid")
    release(seeds)
    columns = ["id", KA, KB, "item_id"]
    return feed.select(*columns, "text", "itext").mapInArrow(_tiles(min_match, coverage, columns), f"id {type_of(src, 'id')}, {KA} long, {KB} long, item_id {type_of(items, 'item_id')}, coverage double, tiles int")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, tiles): the benchmark items that documents hold.

    Words are runs of letters and digits in lower case. Items of fewer than ``min_match`` words, null texts and null
    item ids match nothing; nor do null, empty or short document texts. Rows with a null id are found with a null id;
    rows that repeat, and items that repeat under one id, are returned once, with the largest coverage, and of equal
    ones the fewest tiles. Texts are taken whole; the places of words that a text and an item share by ``min_match`` in
    a row are held for one pair at a time. Empty tables give no rows. Ids keep their types. Other columns aren't read.
    """
    found = overlaps(docs, benchmark, min_match, coverage, id_col, text_col, item_col, item_text_col)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("coverage", (-F.col("tiles")).alias("t"))).alias("m"))
    return best.select(F.col("id").alias("doc_id"), "item_id", F.round("m.coverage", 6).alias("coverage"), (-F.col("m.t")).alias("tiles"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, as ``contaminated`` finds them; columns are left alone.

    Rows of null, empty and short texts stay, and rows repeated whole go or stay together.
    """
    bad = small_side(cut(overlaps(docs, benchmark, min_match, coverage, id_col, text_col).select(F.col(KA).alias("_sq_ba"), F.col(KB).alias("_sq_bb")).distinct()))
    own = with_key(docs, id_col, text_col)
    return own.join(bad, (own[KA] == bad["_sq_ba"]) & (own[KB] == bad["_sq_bb"]), "left_anti").drop(KA, KB)
