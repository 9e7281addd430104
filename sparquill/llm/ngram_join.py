"""N-gram Jaccard self-join by chosen paths.

Each distinct set of word n-grams is embedded as ``SLOTS`` min-hash tokens. In every run a set follows the tokens that
a shared hash of (run, path, token) samples, as many as let two sets at the threshold share
``SHARED`` of those they follow, on average. As that is more than one, the paths they share
branch and don't die out, and the chance that they stay together has a lower bound that holds at any depth. A bucket of
a path is brute-forced once it is small, or where its sets agree so much that sampling wouldn't split them; else each of
its sets follows sampled tokens further. Buckets of many thousands of sets that agree that much are brute-forced too, by
pairs of blocks in tasks of their own. Runs are independent and are repeated until a pair at the threshold is found with
the target recall, however deep its buckets are split. Candidates that pass the sketch are verified on the whole sets.
They travel as lists, a set with those that it meets, so that a task holds a bounded number of them and a group of near
copies isn't a row for each of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KA, KB, WORD, bounds, chunked, cut, lists, mix64, release, select_in, small_side, sorted_groups, type_of, with_key

N = 3
THRESHOLD = 0.5
TARGET_RECALL = 0.99
#: Tokens of a set's embedding, and how many of those that a pair at the threshold shares both follow from each node, on average.
SLOTS, SHARED = 128, 1.75
#: Buckets up to this size are brute-forced.
SMALL = 48
#: Buckets beyond this size are split by Spark, the others within a task.
IN_TASK = 20_000
#: A large bucket with more than this share of its parent's sets isn't worth splitting again: pairs would only be compared
#: more often. It is brute-forced in blocks of so many sets.
DENSE, BLOCK = 0.5, 4000
#: Sets that agree with their bucket this much, as a share of what the sketch lets pass, are brute-forced in a task; so
#: are those that would share so many followed tokens with others that splitting wouldn't thin the bucket out.
ALIKE, SPLITS = 0.75, 0.9
#: The sketch lets pass what is no more than this many standard deviations below the threshold.
DEVIATIONS = 3.5
#: Candidate pairs that a task holds before it sends them, and sets in one of the lists that it sends.
HELD_PAIRS, LISTED = 500_000, 128
#: N-grams and pairs that a task of the verification gets at a time; buckets with more are verified by pairs of blocks.
HELD_GRAMS, BUCKET_PAIRS = 4_000_000, 4_000_000

_U = np.uint64
_SLOT_XOR = mix64(np.arange(1, SLOTS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).astype(np.uint32)
_SLOT_MUL = (mix64(np.arange(1, SLOTS + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03)) | _U(1)).astype(np.uint32)
_SLOT_NO = np.arange(SLOTS, dtype=np.uint64) << _U(32)


def least_equal(threshold: float) -> int:
    """Equal tokens that a pair needs to be verified."""
    return max(1, math.floor(SLOTS * threshold - DEVIATIONS * math.sqrt(SLOTS * threshold * (1 - threshold))))


def fanout(threshold: float) -> float:
    """Tokens that a set follows from each node, on average."""
    return SHARED / threshold


def runs_for(threshold: float, recall: float) -> int:
    """Runs until a pair at the threshold is found with this probability, through any number of nodes.

    The number k of equal tokens of the pair is binomial. Given k, a node loses the pair unless a token that both follow
    leads to a node that doesn't; q = 1 - (1 - q * fanout / SLOTS) ** k is the chance that no node ever does.
    """
    k = np.arange(least_equal(threshold), SLOTS + 1)
    log_p = np.array([math.lgamma(SLOTS + 1) - math.lgamma(x + 1) - math.lgamma(SLOTS - x + 1) for x in k]) + k * math.log(threshold) + (SLOTS - k) * math.log(max(1 - threshold, 1e-300))
    p = np.exp(log_p)
    q = np.ones(len(k))
    for _ in range(2000):
        q = 1 - (1 - q * fanout(threshold) / SLOTS) ** k
    for runs in range(1, 400):
        if (p * (1 - (1 - q) ** runs)).sum() >= recall:
            return runs
    raise ValueError(f"no number of runs reaches a recall of {recall} at {threshold}; DEVIATIONS bounds it")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str | None, n: int, hashes: dict[str, int]) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams. A text of fewer than n words has one gram of all; of none, none."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    m = len(words) - k + 1
    g = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            g = (g ^ h[j : j + m]) * _U(0x9E3779B97F4A7C15) + _U(k)
            g ^= g >> _U(29)
    return np.unique(g)


def sketch(grams: np.ndarray) -> np.ndarray:
    """The smallest value under each of the slots' permutations."""
    x = mix64(grams).astype(np.uint32)
    out = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        np.minimum(out, ((x[lo : lo + 1024, None] ^ _SLOT_XOR) * _SLOT_MUL).min(axis=0), out=out)
    return out


def short(sig: np.ndarray) -> np.ndarray:
    """A byte of each token. Tokens that differ have equal ones by chance only, which lets more pass but loses nothing."""
    return (mix64(sig.astype(np.uint64)) & _U(255)).astype(np.uint8)


def chosen(path: np.ndarray, sig: np.ndarray, fan: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) for each token that a row's path samples."""
    limit = _U(int(fan / SLOTS * 2**32))
    with np.errstate(over="ignore"):
        h = mix64((sig.astype(np.uint64) | _SLOT_NO) * _U(0xA24BAED4963EE407) + path[:, None])
    row, slot = np.nonzero((h >> _U(32)) < limit)
    return row, mix64(h[row, slot] ^ (path[row] * _U(3)))


def _all_pairs(groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the members of each group."""
    left, right = [], []
    by_size: dict[int, list[np.ndarray]] = {}
    for g in groups:
        by_size.setdefault(len(g), []).append(g)
    for n, gs in by_size.items():
        i, j = np.triu_indices(n, 1)
        stack = np.stack(gs)
        left.append(stack[:, i].ravel())
        right.append(stack[:, j].ravel())
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def equal_tokens(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal bytes of each row; eight are counted at a time, each in a byte of its own that can't overflow."""
    same = np.ascontiguousarray(x == y).view(np.uint64).sum(axis=1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        low = (same & _U(0x00FF00FF00FF00FF)) + ((same >> _U(8)) & _U(0x00FF00FF00FF00FF))
        return ((low * _U(0x0001000100010001)) >> _U(48)).astype(np.int64)


class _Bucket:
    """Sets of a batch: bytes of their tokens, and their sizes, which can't differ too much in a similar pair."""

    def __init__(self, sig: np.ndarray, size: np.ndarray, threshold: float):
        self.sig, self.size, self.threshold, self.least = sig, size, threshold, least_equal(threshold)

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of these pairs pass."""
        x, y = self.size[a], self.size[b]
        near = np.flatnonzero(np.minimum(x, y) >= self.threshold * np.maximum(x, y) - 1e-6)
        keep = [np.zeros(0, np.int64)]
        for lo in range(0, len(near), 8000):
            at = near[lo : lo + 8000]
            keep.append(at[equal_tokens(self.sig[a[at]], self.sig[b[at]]) >= self.least])
        return np.concatenate(keep)

    def against(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that pass with x."""
        n = self.size[others]
        near = others[np.minimum(n, self.size[x]) >= self.threshold * np.maximum(n, self.size[x]) - 1e-6]
        return near[equal_tokens(self.sig[near], self.sig[x]) >= self.least] if len(near) else near

    def pairs(self, members: np.ndarray, path: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidate pairs of one large bucket: brute force where sets agree, else the next nodes of the paths."""
        fan = fanout(self.threshold)
        alike = min(ALIKE * self.least / SLOTS, SPLITS / fan)
        todo: list[tuple[int, np.ndarray]] = [(path, members)]
        while todo:
            p, rows = todo.pop()
            # The average similarity of each set to the bucket, from the counts of equal tokens.
            s = self.sig[rows]
            agree = np.zeros(len(rows))
            for slot in range(SLOTS):
                agree += np.bincount(s[:, slot], minlength=256)[s[:, slot]] - 1
            dense = agree >= alike * SLOTS * max(1, len(rows) - 1)
            if dense.any():
                d, rest = rows[dense], rows[~dense]
                for k, x in enumerate(d):
                    hit = self.against(x, np.concatenate([d[k + 1 :], rest]))
                    yield np.full(len(hit), x), hit
                rows = rest
            if len(rows) < 2:
                continue
            r, child = chosen(np.full(len(rows), p, np.uint64), self.sig[rows], fan)
            order = np.argsort(child, kind="stable")
            r, child = r[order], child[order]
            at = bounds(child)
            small = []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo < 2:
                    continue
                if hi - lo <= SMALL:
                    small.append(rows[r[lo:hi]])
                else:
                    todo.append((int(child[lo]), rows[r[lo:hi]]))
            a, b = _all_pairs(small)
            keep = self.similar(a, b)
            yield a[keep], b[keep]

    def block_pairs(self, side: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a left and a right block (sides 1 and 2), or of a block with itself (side 3)."""
        left = np.arange(lo, hi)[side[lo:hi] != 2]
        right = np.arange(lo, hi)[side[lo:hi] == 2]
        for k, x in enumerate(left):
            hit = self.against(x, left[k + 1 :] if side[x] == 3 else right)
            yield np.full(len(hit), x), hit


def sketches(docs: DataFrame, n: int, threshold: float, runs: int) -> DataFrame:
    """(id, key, set hash s1 s2, size, sig, paths) of every row; of rows without words the last five are null."""
    fan = fanout(threshold)
    roots = mix64(np.arange(1, runs + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for part in chunked(batches, "text", 2_000_000):
            s1, s2, size, sigs, kept = [], [], [], [], []
            for i, t in enumerate(part.column("text").to_pylist()):
                g = shingles(t, n, hashes)
                if len(g):
                    kept.append(i)
                    size.append(len(g))
                    h = xxhash.xxh3_128_digest(g.tobytes())
                    s1.append(int.from_bytes(h[:8], "big", signed=True))
                    s2.append(int.from_bytes(h[8:], "big", signed=True))
                    sigs.append(sketch(g))
                if len(hashes) > 500_000:
                    hashes.clear()
            sig = np.stack(sigs) if sigs else np.zeros((0, SLOTS), np.uint32)
            row, path = [], []
            for root in roots:
                r, child = chosen(np.full(len(sig), root, np.uint64), sig, fan)
                row.append(r)
                path.append(child)
            row, path = np.concatenate(row), np.concatenate(path)
            order = np.argsort(row, kind="stable")
            paths = lists(path[order].view(np.int64), np.bincount(row, minlength=len(sig)), pa.int64())
            bytes_ = short(sig)
            found = [pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(size, pa.int32()), pa.array([x.tobytes() for x in bytes_], pa.binary()), paths]
            at = np.full(part.num_rows, -1)
            at[kept] = np.arange(len(kept))
            take = pa.array(at, mask=at < 0)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column(KA), part.column(KB), *(x.take(take) for x in found)], ["id", KA, KB, "s1", "s2", "size", "sig", "paths"])

    return docs.select("id", KA, KB, "text").mapInArrow(run, f"id {type_of(docs, 'id')}, {KA} long, {KB} long, s1 long, s2 long, size int, sig binary, paths array<long>")


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), SLOTS)


def _next_paths(fan: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                row, child = chosen(part.column("path").to_numpy().view(np.uint64), _sig_matrix(part.column("sig")), fan)
                p = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), p.column("sid"), p.column("above")], ["path", "sid", "above"])

    return run


def _listed(changes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Lists of the values between changes, of no more than LISTED each, and where each list starts."""
    start = np.flatnonzero(changes)
    length = np.diff(np.append(start, len(changes)))
    parts = -(-length // LISTED)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(start, parts) + nth * LISTED
    return start, lists(values, np.diff(np.append(start, len(changes))), pa.int64())


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys isn't what it was a row before."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for key in keys:
        out[1:] |= key[1:] != key[:-1]
    return out


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, b) of all that the lists of a batch hold."""
    column = batch.column("bs")
    at = column.offsets.to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(at)), column.values.to_numpy()[at[0] : at[-1]]


def _candidates(threshold: float):
    """Lists (path, a, bs) of candidates of buckets that come by path and set; a pair of a path may be in several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_groups(batches, "path", 8000):
            path, side, sid = (batch.column(c).to_numpy() for c in ("path", "side", "sid"))
            bucket = _Bucket(_sig_matrix(batch.column("sig")), batch.column("size").to_numpy(), threshold)
            at = bounds(path)
            n = batch.num_rows

            def found(path=path, side=side, bucket=bucket, at=at) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                small = []
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if hi - lo < 2:
                        continue
                    if side[lo]:
                        yield from bucket.block_pairs(side, lo, hi)
                    elif hi - lo <= SMALL:
                        small.append(np.arange(lo, hi))
                    else:
                        yield from bucket.pairs(np.arange(lo, hi), int(path[lo : lo + 1].view(np.uint64)[0]))
                a, b = _all_pairs(small)
                keep = bucket.similar(a, b)
                yield a[keep], b[keep]

            def sent(held: list[np.ndarray], path=path, sid=sid, n=n) -> pa.RecordBatch:
                # Rows of a bucket are sorted by set, so the lower row is the lower set.
                lo, hi = np.divmod(np.unique(np.concatenate(held)), n)
                start, bs = _listed(_changes(lo), sid[hi])
                return pa.RecordBatch.from_arrays([pa.array(path[lo[start]]), pa.array(sid[lo[start]]), bs], ["path", "a", "bs"])

            held, count = [], 0
            for a, b in found():
                held.append(np.minimum(a, b) * n + np.maximum(a, b))
                count += len(a)
                if count >= HELD_PAIRS:
                    yield sent(held)
                    held, count = [], 0
            if count:
                yield sent(held)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lists sorted by a and path: each pair once, with the lowest of its paths."""
    for batch in sorted_groups(batches, "a", 2000):
        row, b = _flat(batch)
        path, a = batch.column("path").to_numpy()[row], batch.column("a").to_numpy()[row]
        order = np.lexsort((b, a))  # stable: the lowest path of a pair stays first
        order = order[_changes(a[order], b[order])]
        order = order[np.lexsort((path[order], a[order]))]
        path, a, b = path[order], a[order], b[order]
        start, bs = _listed(_changes(a, path), b)
        yield pa.RecordBatch.from_arrays([pa.array(path[start]), pa.array(a[start]), bs], ["path", "a", "bs"])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of (path, a, bs, blocks) by pairs of blocks: (bucket, a, bs)."""
    for batch in batches:
        row, b = _flat(batch)
        path, a, blocks = (batch.column(c).to_numpy().view(np.uint64) for c in ("path", "a", "blocks"))
        m, o = (mix64(a) % blocks)[row], mix64(b.view(np.uint64)) % blocks[row]
        with np.errstate(over="ignore"):
            bucket = mix64(path[row] ^ mix64(np.minimum(m, o) * _U(1 << 32) + np.maximum(m, o) + _U(1)))
        order = np.lexsort((bucket, row))
        row, b, bucket = row[order], b[order], bucket[order]
        start, bs = _listed(_changes(row, bucket), b)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[start].view(np.int64)), pa.array(a[row[start]].view(np.int64)), bs], ["bucket", "a", "bs"])


class _Group:
    """Sets of a bucket of the verification: their n-grams as numbers, the rows that have them, what they are linked to."""

    def __init__(self, sids: list[int], grams: list[np.ndarray], rows: list[int]):
        order = np.argsort(np.array(sids, np.int64))
        grams = [grams[k] for k in order]
        self.sids, self.rows = np.array(sids, np.int64)[order], np.array(rows, np.int64)[order]
        self.size = np.array([len(g) for g in grams], np.int64)
        known = np.concatenate(grams)
        known.sort()
        known = known[_changes(known)]
        self.grams = [np.searchsorted(known, g).astype(np.int32) for g in grams]
        self.mark = np.zeros(len(known), np.uint8)
        self.links = np.zeros(len(sids), np.int64)
        self.root = np.arange(len(sids))

    def similar(self, x: int, ys: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of ys that are similar to x, and their similarities."""
        self.mark[self.grams[x]] = 1
        common = np.add.reduceat(self.mark[np.concatenate([self.grams[y] for y in ys])], np.cumsum(self.size[ys]) - self.size[ys], dtype=np.int64)
        self.mark[self.grams[x]] = 0
        j = common / (self.size[x] + self.size[ys] - common)
        keep = j >= threshold
        return ys[keep], j[keep]

    def link(self, x: int, ys: np.ndarray) -> list[int]:
        """Count links of x to different ys; those of them that connect what wasn't connected."""
        self.links[x] += self.rows[ys].sum()
        self.links[ys] += self.rows[x]
        new = []
        for y in ys[self.root[ys] != self.root[x]].tolist():
            if self.root[y] != self.root[x]:
                self.root[self.root == self.root[y]] = self.root[x]
                new.append(y)
        return new


def _verify(n: int, threshold: float, linked: bool):
    """Exact similarities of a bucket's pairs: (a, b, jaccard), or for each set (a, null, links), and pairs (a, b, 0) that connect what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        now, group = None, None
        sids: list[int] = []
        grams: list[np.ndarray] = []
        weights: list[int] = []
        out: list[tuple[pa.Array, pa.Array, pa.Array]] = []
        count = 0

        def add(a: np.ndarray, b: np.ndarray | None, value: np.ndarray) -> None:
            nonlocal count
            out.append((pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array(value, pa.float64())))
            count += len(a)

        def batch_of() -> pa.RecordBatch:
            nonlocal count
            made = pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out, strict=True)], ["a", "b", "value"])
            out.clear()
            count = 0
            return made

        def end() -> None:
            if linked and group is not None and (at := np.flatnonzero(group.links)).size:
                add(group.sids[at], None, group.links[at])

        for batch in batches:
            bucket, kind, a, rows = (batch.column(c).to_numpy() for c in ("bucket", "kind", "a", "rows"))
            text, bs = batch.column("text"), batch.column("bs")
            at, values = bs.offsets.to_numpy(), bs.values.to_numpy()
            for i in range(batch.num_rows):
                if bucket[i] != now:
                    end()
                    now, group, sids, grams, weights = bucket[i], None, [], [], []
                if kind[i] == 0:
                    sids.append(int(a[i]))
                    grams.append(shingles(text[i].as_py(), n, hashes))
                    weights.append(int(rows[i]))
                    if len(hashes) > 500_000:
                        hashes.clear()
                    continue
                if group is None:
                    group = _Group(sids, grams, weights)
                    grams = []
                x, ys = int(np.searchsorted(group.sids, a[i])), np.searchsorted(group.sids, values[at[i] : at[i + 1]])
                ys, j = group.similar(x, ys, threshold)
                if not len(ys):
                    continue
                if not linked:
                    add(np.full(len(ys), a[i]), group.sids[ys], j)
                elif new := group.link(x, ys):
                    add(np.full(len(new), a[i]), group.sids[new], np.zeros(len(new)))
                if count > 50_000:
                    yield batch_of()
        end()
        if out:
            yield batch_of()

    return run


def _blocks_of(dense: DataFrame) -> DataFrame:
    """(path, sid, side): each set of a bucket goes to all pairs of blocks that its own block is in."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = dense.withColumn("m", F.pmod(F.xxhash64("path", "sid"), blocks).cast("int"))
    other = own.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    lo, hi = F.least("m", "o"), F.greatest("m", "o")
    side = F.when(F.col("m") == F.col("o"), 3).when(F.col("m") < F.col("o"), 1).otherwise(2)
    return other.select(F.xxhash64("path", lo, hi, F.lit(5)).alias("path"), "sid", side.alias("side"))


class Similar:
    """The sets of a table's rows and their candidate pairs."""

    def __init__(self, keyed: DataFrame, n: int, threshold: float, recall: float):
        self.keyed, self.n, self.threshold = keyed, n, threshold
        #: (id, key, s1, s2) of every row.
        self.sketched = cut(sketches(keyed, n, threshold, runs_for(threshold, recall)))
        self.members = self.sketched.select("id", KA, KB, "s1", "s2")
        # The row of the lowest id (nulls last, then by key) stands for a set.
        own = F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id"), F.col(KA).alias("ka"), F.col(KB).alias("kb"))).alias("own")
        sets = self.sketched.where("s1 is not null").groupBy("s1", "s2").agg(own, F.count("*").alias("rows"), F.first(F.struct("size", "sig", "paths")).alias("x"))
        #: (sid, s1, s2, own, rows, size, sig, paths) of every distinct set; numbers are given once, by the table written.
        self.sets = cut(sets.select(F.monotonically_increasing_id().alias("sid"), "s1", "s2", "own", "rows", "x.*"))

    def candidates(self) -> DataFrame:
        """(path, a, bs): a set and higher ones that pass the sketch with it, each pair once, and a bucket that all are in."""
        sigs = self.sets.select("sid", "size", "sig")
        rows = self.sets.select("sid", F.explode("paths").alias("path"), F.lit(None).cast("long").alias("above"))
        found, spent = [], []
        size = F.col("n")
        while True:
            # Sizes come by an aggregation with partial counts, so that no task has to hold a large bucket.
            sizes = cut(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
            spent.append(sizes)
            rows = rows.join(small_side(sizes), "path")
            found.append(rows.where(size <= IN_TASK).select("path", "sid", F.lit(0).alias("side")))
            if sizes.where(size > IN_TASK).isEmpty():
                break
            large = rows.where(size > IN_TASK)
            dense = F.coalesce(size > F.col("above") * DENSE, F.lit(False))
            found.append(_blocks_of(large.where(dense)))
            further = large.where(~dense).select("path", "sid", size.alias("above")).join(sigs, "sid")
            rows = cut(further.select("path", "above", "sid", "sig").mapInArrow(_next_paths(fanout(self.threshold)), "path long, sid long, above long").dropDuplicates(["path", "sid"]))
            spent.append(rows)
        buckets = found[0]
        for more in found[1:]:
            buckets = buckets.unionByName(more)
        pairs = buckets.join(sigs, "sid").select("path", "sid", "side", "size", "sig").repartition("path").sortWithinPartitions("path", "sid").mapInArrow(_candidates(self.threshold), "path long, a long, bs array<long>")
        out = cut(pairs.repartition("a").sortWithinPartitions("a", "path").mapInArrow(_once, "path long, a long, bs array<long>"))
        release(*spent)
        return out

    def verified(self, linked: bool) -> DataFrame:
        """(a, b, value) as ``_verify`` gives them."""
        pairs = self.candidates()
        # Sets meet for verification in a bucket of theirs, so that a group's texts travel once and not once a pair.
        wanted = lambda df, by: df.select(by, F.col("a").alias("sid")).union(df.select(by, F.explode("bs"))).distinct()
        facts = self.sets.select("sid", "size", "rows", F.col("own.ka").alias(KA), F.col("own.kb").alias(KB))
        load = wanted(pairs, "path").join(facts.select("sid", "size"), "sid").groupBy("path").agg(F.sum("size").alias("grams"))
        load = load.join(pairs.groupBy("path").agg(F.sum(F.size("bs")).alias("pairs")), "path").where((F.col("grams") > HELD_GRAMS) | (F.col("pairs") > BUCKET_PAIRS))
        # Two blocks are held at a time; of k blocks, two share 2 / k ** 2 of the pairs.
        blocks = F.greatest(F.ceil(2 * F.col("grams") / HELD_GRAMS), F.ceil(F.sqrt(2 * F.col("pairs") / BUCKET_PAIRS))).cast("long")
        heavy = cut(load.select("path", blocks.alias("blocks")))
        placed = pairs.withColumnRenamed("path", "bucket")
        if not heavy.isEmpty():
            side = small_side(heavy)
            light = pairs.join(side.select("path"), "path", "left_anti").select(F.col("path").alias("bucket"), "a", "bs")
            placed = cut(light.unionByName(pairs.join(side, "path").select("path", "a", "bs", "blocks").mapInArrow(_apart, "bucket long, a long, bs array<long>")))
        visits = cut(wanted(placed, "bucket").join(facts, "sid"))
        nodes = small_side(cut(visits.select(KA, KB).distinct()))
        # Repeated rows have equal keys and texts; one of them is enough.
        texts = self.keyed.select(KA, KB, "text").join(nodes, [KA, KB], "left_semi").dropDuplicates([KA, KB])
        none = F.lit(None)
        feed = texts.join(visits, [KA, KB]).select("bucket", F.lit(0).alias("kind"), F.col("sid").alias("a"), "rows", "text", none.cast("array<long>").alias("bs")).unionByName(
            placed.select("bucket", F.lit(1).alias("kind"), "a", F.lit(0).cast("long").alias("rows"), none.cast("string").alias("text"), "bs")
        )
        return feed.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_verify(self.n, self.threshold, linked), "a long, b long, value double")

    def classes(self) -> DataFrame:
        """(s1, s2, best, links): of each set its class's best row (z, id, ka, kb), and the rows that are similar to a row of it."""
        found = cut(self.verified(True))
        edges = found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))
        links = found.where("b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("value").cast("long").alias("others"))
        joined = self.sets.select("sid", "s1", "s2", "own", "rows").join(links, "sid", "left").join(components(edges).withColumnRenamed("node", "sid"), "sid", "left")
        joined = joined.withColumn("root", F.coalesce("root", "sid"))
        best = joined.groupBy("root").agg(F.min("own").alias("best"))
        return joined.join(best, "root").select("s1", "s2", "best", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("links"))


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) for every row: the lowest id of its class, and the number of rows as similar as that.

    Rows are linked if their sets of word n-grams are at least that similar, and classes are what links connect. Rows
    with equal sets are linked exactly, whatever their number; other links are found with the target recall, and each
    is verified, so links between different texts are all counted though copies aren't expanded into pairs. Words are
    runs of letters and digits in lower case. A text of fewer than n words has one gram; a null, empty or wordless text
    has none, so its row is a class of its own with no links. Repeated rows are rows of their own. A row of null id has
    one too, with the class of those it is like; a class of null ids only has a null id. Texts of any length are whole;
    ties can't be, as nothing is chosen. An empty table gives no rows. Ids may be of any type that has an order. Other
    columns aren't read.
    """
    found = Similar(select_in(docs, id_col, text_col), n, threshold, recall)
    classes = found.classes().toDF("c1", "c2", "best", "links")
    out = found.members.join(classes, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left")
    own = F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id"))
    return out.select(F.col("id").alias("doc_id"), own.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, set_id) of every row, and (set_a, set_b, jaccard) of the different sets that are that similar.

    Rows of one set_id have equal sets, and so a similarity of 1. A row without words has a null set_id. For the rest
    what is said of ``ngram_jaccard_join`` holds.
    """
    found = Similar(select_in(docs, id_col, text_col), n, threshold, recall)
    named = found.sets.select("sid", F.col("s1").alias("c1"), F.col("s2").alias("c2"))
    members = found.members.join(named, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left").select(F.col("id").alias("doc_id"), F.col("sid").alias("set_id"))
    return members, found.verified(False).select(F.col("a").alias("set_a"), F.col("b").alias("set_b"), F.col("value").alias("jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of (u, v); nodes may be of any orderable type. Alternates large and small stars."""
    state = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("s"))
    # (u, v) with u > v
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    seen = now.agg(state).first()
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(root.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        after = cut(small)
        state_after = after.agg(state).first()
        release(now)
        # The edges are a set; the same count, xor and sum of their hashes are taken for the same set.
        if state_after == seen:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, seen = after, state_after


def drop_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each class of ``ngram_jaccard_join``.

    The row of the lowest id stays (nulls last, then by a hash of id and text). Rows repeated whole are copies too and
    one stays; which of them can't be told. Rows without words stay as they are, also if they repeat. Texts may be of
    any length. An empty table gives no rows. Columns and their names are left alone.
    """
    found = Similar(select_in(docs, id_col, text_col), n, threshold, recall)
    classes = found.classes().select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("best.ka").alias("ba"), F.col("best.kb").alias("bb"))
    keys = found.members.where("s1 is not null").groupBy(KA, KB, "s1", "s2").agg(F.count("*").alias("rows"))
    ranked = keys.join(classes, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")))
    best = (F.col(KA) == F.col("ba")) & (F.col(KB) == F.col("bb"))
    # Of a key that is repeated, all rows but one have to go, or all.
    fate = cut(ranked.where(~best | (F.col("rows") > 1)).select(F.col(KA).alias("_sq_fa"), F.col(KB).alias("_sq_fb"), best.alias("_sq_one")))
    own = with_key(docs, id_col, text_col)
    at = lambda df: (own[KA] == df["_sq_fa"]) & (own[KB] == df["_sq_fb"])
    gone = small_side(fate)
    names = [F.col(f"`{c}`") for c in docs.columns]
    plain = own.join(gone, at(gone), "left_anti").select(*names)
    one = small_side(fate.where("_sq_one"))
    return plain if one.isEmpty() else plain.unionByName(own.join(one, at(one), "left_semi").dropDuplicates([KA, KB]).select(*names))
