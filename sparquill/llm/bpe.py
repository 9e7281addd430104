"""Byte-level BPE encoding and decoding by replaying merges over a corpus.

A shard of the corpus (the documents of a task, in bounded chunks) is reduced to its distinct words. Their bytes
lie in one flat array of symbols with links to the left and right neighbour. An inverted index holds, for each rank of
the merge list, the positions where that pair stands. Ranks are taken in order: all positions of a rank are merged at
once, and only the neighbours they touch get new entries in the index. A token of a merge list is made by one merge
only, so pairs with it have higher ranks, and the order of ranks is the order in which each word would be merged alone.
Documents then gather the tokens of their words. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunked, lists

#: The public vocabulary that is read where no other is named.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: How text is cut into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text whose distinct words are merged together.
CHUNK_BYTES = 24_000_000


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(x for x in range(256) if x not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


class Merges:
    """A merge list as arrays: sorted pair keys, and the rank and product of each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.size = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.of_byte = np.zeros(256, np.int32)
        for ch, b in letters.items():
            self.of_byte[b] = vocab[ch]
        pieces = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        # A direct table of the pairs of single bytes, which are most of the look-ups.
        self.slots = 1 << 18
        self.bloom = np.zeros(self.slots, bool)
        self.bloom[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 >> 13) & (self.slots - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = left.astype(np.int64) * self.size + right
        out = np.full(len(keys), -1, np.int32)
        may = np.flatnonzero(self.bloom[self._slot(keys)])
        if len(may):
            k = keys[may]
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            out[may] = np.where(self.keys[at] == k, self.ranks[at], -1)
        return out


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after another, and the number of each word's tokens."""
    lengths = np.array([len(w) for w in words], np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int32), lengths
    token = merges.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    ends = np.cumsum(lengths)
    nxt = np.arange(1, total + 1, dtype=np.int64)
    nxt[ends[lengths > 0] - 1] = -1
    prev = np.arange(-1, total - 1, dtype=np.int64)
    prev[(ends - lengths)[lengths > 0]] = -1
    alive = np.ones(total, bool)

    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def post(positions: np.ndarray) -> None:
        """Enter the pairs that start at these positions into the index."""
        ranks = merges.rank(token[positions], token[nxt[positions]])
        known = ranks >= 0
        positions, ranks = positions[known], ranks[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for part, r in zip(np.split(positions, cuts), ranks[np.concatenate([[0], cuts])].tolist(), strict=True):
            if r not in index:
                index[r] = []
                heapq.heappush(queue, r)
            index[r].append(part)

    post(np.flatnonzero(nxt >= 0))
    while queue:
        r = heapq.heappop(queue)
        parts = index.pop(r)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        a, b = merges.left[r], merges.right[r]
        at = at[alive[at] & (token[at] == a) & (nxt[at] >= 0)]
        at = at[token[nxt[at]] == b]
        if a == b and len(at) > 1:
            # In a run of equal symbols every second pair is taken, from the left.
            at = np.sort(at)
            follows = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
            n = np.arange(len(at))
            start = np.maximum.accumulate(np.where(follows, 0, n))
            at = at[(n - start) % 2 == 0]
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        token[at] = merges.product[r]
        alive[gone] = False
        nxt[at] = after
        has = after >= 0
        prev[after[has]] = at[has]
        before = prev[at]
        post(np.unique(np.concatenate([before[before >= 0], at[has]])))
    kept = np.add.reduceat(alive, (ends - lengths)[lengths > 0]) if (lengths > 0).any() else np.zeros(0, int)
    counts = np.zeros(len(words), np.int64)
    counts[lengths > 0] = kept
    return token[alive], counts


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of consecutive runs that begin at ``starts`` and have ``counts`` members."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return shift + np.arange(total)


class _Words(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def encode_texts(texts: list[str | None], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, one after another, and the number of each text's tokens."""
    find = regex.compile(PATTERN).findall
    words = _Words()
    number = words.__getitem__
    used = [np.fromiter(map(number, find(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
    flat, counts = replay([w.encode("utf-8", "surrogatepass") for w in words], merges)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
    every = np.concatenate(used) if used else np.zeros(0, np.int32)
    per_word = counts[every] if len(every) else np.zeros(0, np.int64)
    ids = flat[gather(starts[every], per_word)] if len(every) else np.zeros(0, np.int32)
    sums = np.concatenate([[0], np.cumsum(per_word)])
    at = np.cumsum([0] + [len(u) for u in used])
    return ids, sums[at[1:]] - sums[at[:-1]]


def decode_bytes(ids: np.ndarray, merges: Merges) -> bytes:
    """The bytes that these tokens stand for."""
    ids = ids.astype(np.int64)
    return merges.bytes[gather(merges.starts[ids], merges.lengths[ids])].tobytes()


@lru_cache(4)
def load(path: str) -> Merges:
    return Merges(path)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """(id, token_ids, n_tokens, exact) for every row of ``docs``.

    ``exact`` says that the decoded tokens are the text again; it is checked for every row, and true by construction.
    A null id stays null. A null or empty text has no tokens and is exact. Repeated rows are encoded each. Other
    columns are not read. An empty table gives no rows. Texts may be of any length: a chunk holds one row at least.
    The vocabulary file is read on the driver and sent to the workers; its size doesn't depend on the corpus.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(load(vocabulary))
    src = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = shared.value
        for chunk in chunked(batches, "text", CHUNK_BYTES):
            texts = chunk.column("text").to_pylist()
            ids, counts = encode_texts(texts, merges)
            ok = np.ones(len(texts), bool)
            if verify:
                ends = np.cumsum(counts)
                for n, t in enumerate(texts):
                    ok[n] = decode_bytes(ids[ends[n] - counts[n] : ends[n]], merges) == (t or "").encode()
            step = max(1, len(texts) // 8)
            at = np.concatenate([[0], np.cumsum(counts)])
            for lo in range(0, len(texts), step):
                hi = min(lo + step, len(texts))
                yield pa.RecordBatch.from_arrays([chunk.column("id").slice(lo, hi - lo), lists(ids[at[lo] : at[hi]], counts[lo:hi], pa.int32()), pa.array(counts[lo:hi].astype(np.int32)), pa.array(ok[lo:hi])], ["id", "token_ids", "n_tokens", "exact"])

    return src.mapInArrow(run, f"id {kind}, token_ids array<int>, n_tokens int, exact boolean").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", tokens_col: str = "token_ids") -> DataFrame:
    """(id, text) from (id, token ids), whatever other columns there are.

    Null token lists give null texts, empty ones empty texts; bytes that are no UTF-8 become U+FFFD. Null ids stay, and
    repeated rows are decoded each. Lists may be of any length. An empty table gives no rows.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(load(vocabulary))
    src = tokens.select(tokens[f"`{id_col}`"].alias("id"), tokens[f"`{tokens_col}`"].cast("array<int>").alias("token_ids"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x is None else decode_bytes(np.array(x, np.int64), shared.value).decode("utf-8", "replace") for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "text"])

    return src.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
