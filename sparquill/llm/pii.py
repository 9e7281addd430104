"""PII tagging by a linear-chain conditional random field over word shapes.

The model is trained from a small labelled table on the driver, in numpy: features of a token come from its shape and
those of its neighbours; ordinary words have a case, a length and an ending. Tokens of equal features are one type.
Every token of every text is scored. Where all tokens around one speak so clearly for O that no path, whatever stands
beyond, could do better with another label there, that token is O on the best path of the whole text. This is proved
from the trained weights, not assumed; a model that allows no such proof has its texts decoded whole. What is left
between such tokens is decoded by Viterbi, in batches, and the labels are those of decoding the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked
from .pii_labels import KINDS, labelled_rows, luhn

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
O = 0  # noqa: E741
#: Tokens, with padding, that are decoded at a time; a longer piece is decoded alone.
BATCH_TOKENS = 100_000
#: Bytes of text that are scored at a time; a longer text is scored alone.
BATCH_BYTES = 2_000_000
#: What ``str.split`` gives, with places.
TOKEN = re.compile(r"\S+")
#: A token with such a sign isn't an ordinary word.
TELLING = re.compile(r"[0-9@=+\"'()_\[\]<]")
EDGE = ".,;:!?*#$%&|()[]<>\"'"
_LETTERS = re.compile(r"[^\W\d_]+")
_HEX = re.compile(r"[0-9a-fA-F]+")


def features(token: str) -> list[str]:
    """Features of a token's shape."""
    core = token.strip(EDGE)
    if not TELLING.search(token):
        if not core:
            return ["signs"]
        case = "lower" if core.islower() else "upper" if core.isupper() else "title" if core.istitle() else "mixed"
        return ["word", f"case={case}", f"word-len={min(len(core), 12)}", f"ending={core[-2:].lower()}"]
    long = re.sub(r"\d", "d", _LETTERS.sub(lambda m: "x" * len(m[0]), core))
    runs = re.sub(r"x+", "x", re.sub(r"d+", "d", long))
    exact = re.sub(r"x+", "x", long)
    digits = sum(c.isdigit() for c in token)
    f = [f"shape={runs}" if len(runs) <= 24 else "shape=long", f"digits={exact}" if len(exact) <= 24 else "digits=long", f"n={min(digits, 20)}", f"len={min(len(core) // 4, 12)}", f"edge={token[0] if token[0] in EDGE else ''}", f"start={long[:2]}", f"end={long[-2:]}"]
    if "@" in core[1:-1] and "." in core.rsplit("@", 1)[1]:
        f.append("at.host")
    if core and _HEX.fullmatch(core):
        f.append(f"hex={min(len(core) // 8, 8)}")
        if len(core) >= 32:
            f.append("hex-long")
    if len(core) >= 16 and digits >= 2 and sum(c.isalpha() for c in core) >= 4 and "@" not in core and "/" not in core:
        f.append("random" if len(re.findall(r"[a-zA-Z][0-9]|[0-9][a-zA-Z]", core)) >= 4 else "parts")
    if len(core) >= 16 and core.isalnum() and core.isupper():
        f.append("capitals")
    if "@" not in core:
        f.append("no-at")
    if core and len(core) > 3 and core.isdigit():
        f.append(f"number={min(len(core), 20)}")
    bare = core.replace("-", "")
    if 13 <= len(bare) <= 19 and bare.isascii() and bare.isdigit():
        f.append(f"check-digit={luhn(bare)}")
    if core.count(".") == 3 and core.replace(".", "").isdigit():
        f.append("quad")
    if token.startswith("+") and core.strip("+").isdigit():
        f.append("plus")
    if re.fullmatch(r"\(\d{3}\)", token):
        f.append("area")
    return f


@dataclass
class Model:
    """Weights of a token's features, of those of its neighbours, and of label pairs."""

    number: dict[str, int]
    #: By place (self, previous, next), feature and label.
    weights: np.ndarray
    #: From label, to label.
    trans: np.ndarray
    first: np.ndarray
    #: Types by token, and by their features; scores of types.
    types: dict[str, int] = field(default_factory=dict)
    known: dict[tuple[int, ...], int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 3, len(LABELS))))

    def type_of(self, token: str) -> int:
        ids = tuple(sorted({self.number[f] for f in features(token) if f in self.number}))
        at = self.known.setdefault(ids, len(self.known))
        if at >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(64, len(self.table)), 3, len(LABELS)))])
        if at == len(self.known) - 1:
            self.table[at] = self.weights[:, list(ids)].sum(axis=1)
        self.types[token] = at
        return at

    def emissions(self, tokens: list[str], begins: np.ndarray | None = None) -> np.ndarray:
        """Scores of labels for each token; ``begins`` says where texts begin, which aren't neighbours."""
        if len(self.types) > 500_000 or len(self.known) > 100_000:
            self.types.clear()
            self.known.clear()
        get, new = self.types.get, self.type_of
        kinds = np.fromiter((k if (k := get(t)) is not None else new(t) for t in tokens), np.int64, len(tokens))
        s = self.table
        e = s[kinds, 0]
        before, after = s[kinds[:-1], 1], s[kinds[1:], 2]
        if begins is not None and len(tokens) > 1:
            same = ~begins[1:, None]
            before, after = before * same, after * same
        e[1:] += before
        e[:-1] += after
        return e


def train(rows: list[tuple[list[str], list[str]]], steps: int = 300, rate: float = 0.1, l2: float = 1e-4) -> Model:
    """Maximum likelihood by Adam on all rows at once; the same rows give the same model.

    Tokens of equal features are one type, so scores and gradients are those of types, gathered by token.
    """
    number: dict[str, int] = {}
    label = {x: i for i, x in enumerate(LABELS)}
    rows = [r for r in rows if r[0]]
    longest, n, k = max(len(t) for t, _ in rows), len(rows), len(LABELS)
    types: dict[tuple[int, ...], int] = {}
    kind = np.full((longest, n), -1)
    gold = np.zeros((longest, n), np.int64)
    for i, (tokens, tags) in enumerate(rows):
        for t, token in enumerate(tokens):
            f = tuple(sorted({number.setdefault(x, len(number)) for x in features(token)}))
            kind[t, i] = types.setdefault(f, len(types))
            gold[t, i] = label[tags[t]]
    mask = kind >= 0
    has = np.zeros((len(types) + 1, len(number)))  # the last type has no features
    for f, i in types.items():
        has[i, list(f)] = 1
    none = np.full((1, n), -1)
    places = [kind, np.concatenate([none, kind[:-1]]), np.concatenate([kind[1:], none])]
    truth = ((np.arange(k) == gold[..., None]) & mask[..., None]).astype(float)
    pair = (mask[1:] & mask[:-1])[..., None]
    true_pairs = np.einsum("tni,tnj->ij", truth[:-1] * pair, truth[1:] * pair)
    params = [np.zeros((3, len(number), k)), np.zeros((k, k)), np.zeros(k)]
    moment = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, trans, first = params
        e = sum((has @ w[p])[x] for p, x in enumerate(places))
        e = np.exp(e - e.max(axis=2, keepdims=True))
        go = np.exp(trans)
        # Forward and backward in scaled probabilities; past a row's end everything stays as it is.
        alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.ones((longest, n, 1))
        alpha[0] = np.exp(first) * e[0]
        scale[0] = alpha[0].sum(axis=1, keepdims=True)
        alpha[0] /= scale[0]
        for t in range(1, longest):
            x = (alpha[t - 1] @ go) * e[t]
            scale[t] = np.where(mask[t][:, None], x.sum(axis=1, keepdims=True), 1.0)
            alpha[t] = np.where(mask[t][:, None], x / scale[t], alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            x = (e[t + 1] * beta[t + 1]) @ go.T / scale[t + 1]
            beta[t] = np.where(mask[t + 1][:, None], x, 1.0)
        p = alpha * beta * mask[..., None]
        two = np.einsum("tni,tnj->ij", alpha[:-1] * pair, e[1:] * beta[1:] / scale[1:] * pair) * go
        diff = (p - truth).reshape(-1, k)
        grad_w = np.zeros_like(w)
        for place, x in enumerate(places):
            at = np.where(x < 0, len(types), x).ravel()
            by_type = np.stack([np.bincount(at, diff[:, j], len(types) + 1) for j in range(k)], axis=1)
            grad_w[place] = has.T @ by_type
        grads = [grad_w / n + l2 * w, (two - true_pairs) / n + l2 * trans, (p[0] - truth[0]).sum(axis=0) / n + l2 * first]
        for q, g, m, v in zip(params, grads, moment, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(number, params[0], params[1], params[2])


@dataclass
class Clear:
    """Tokens whose labels score no more than ``most`` above O, in a row of 2 * reach - 1, are at O in the middle."""

    reach: int
    most: np.ndarray


def clear_rule(model: Model, samples: list[list[str]], longest: int = 6) -> Clear | None:
    """A rule that holds for this model, or None.

    Whatever the labels at both ends of the row and the scores within the bound, the path through O all along has to be
    better than each that isn't at O in the middle. The bound comes from how the tokens of ``samples`` score; any bound
    gives a true rule if one is found.
    """
    e = np.concatenate([model.emissions(x) for x in samples if x] or [np.zeros((1, len(LABELS)))])
    over = e - e[:, O : O + 1]
    for share in (0.99, 0.97, 0.94, 0.9, 0.8, 0.7, 0.5):
        most = np.quantile(over, share, axis=0)
        most[O] = 0.0
        step = model.trans + most
        into = step.copy()  # from the left end to the token in the middle, and its score
        out = model.trans.copy()  # from it to the right end, whose score both paths have
        for reach in range(1, longest + 1):
            if reach > 1:
                into = (into[:, :, None] + step[None]).max(axis=1)
                out = (step[:, :, None] + out[None]).max(axis=1)
            other = (np.delete(into, O, axis=1)[:, :, None] + np.delete(out, O, axis=0)[None]).max(axis=1)
            through = model.trans[:, O : O + 1] + (2 * reach - 2) * model.trans[O, O] + model.trans[O : O + 1, :]
            if (through > other + 1e-6).all():
                return Clear(reach, most + 1e-9)
    return None


def viterbi(model: Model, pieces: list[np.ndarray], at_start: list[bool], at_end: list[bool] | None = None) -> list[np.ndarray]:
    """Best labels of each piece of emissions, in batches of like length; of equal paths, those of the lowest labels from the end.

    Pieces not at a text's start begin after O, and those not at its end are followed by O.
    """
    at_end = [True] * len(pieces) if at_end is None else at_end
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
    hi = 0
    while hi < len(order):
        lo, hi = hi, hi + 1
        while hi < len(order) and (hi + 1 - lo) * len(pieces[order[hi]]) <= BATCH_TOKENS:
            hi += 1
        part = order[lo:hi]
        lengths = np.array([len(pieces[i]) for i in part])
        longest = int(lengths.max())
        e = np.zeros((len(part), longest, len(LABELS)))
        for r, i in enumerate(part):
            e[r, : lengths[r]] = pieces[i]
        begin = np.where(np.array([at_start[i] for i in part])[:, None], model.first, model.trans[O])
        score = begin + e[:, 0]
        back = np.zeros((len(part), longest, len(LABELS)), np.int8)
        for t in range(1, longest):
            s = score[:, :, None] + model.trans
            back[:, t] = s.argmax(axis=1)
            score = np.where((t < lengths)[:, None], s.max(axis=1) + e[:, t], score)
        last = (score + np.where(np.array([at_end[i] for i in part])[:, None], 0.0, model.trans[:, O])).argmax(axis=1)
        rows = np.arange(len(part))
        y = np.zeros((len(part), longest), np.int64)
        y[rows, lengths - 1] = last
        for t in range(longest - 1, 0, -1):
            y[:, t - 1] = np.where(t < lengths, back[rows, t, y[:, t]], y[:, t - 1])
        for r, i in enumerate(part):
            out[i] = y[r, : lengths[r]]
    return out


def label_texts(model: Model, texts: list[str | None], rule: Clear | None) -> list[tuple[int, list[int]]]:
    """(number of the text, labels of its tokens) of the texts that have any but O."""
    split = [t.split() if t else [] for t in texts]
    lengths = np.array([len(x) for x in split], np.int64)
    tokens = [t for x in split for t in x]
    if not tokens:
        return []
    ends = np.cumsum(lengths)
    starts = ends - lengths
    begins = np.zeros(len(tokens) + 1, bool)
    begins[starts[lengths > 0]] = True
    begins[-1] = True
    e = model.emissions(tokens, begins[:-1])
    sure = np.zeros(len(tokens), bool)
    if rule is not None:
        fits = (e - e[:, O : O + 1] <= rule.most).all(axis=1)
        # How many tokens in a row fit up to each one, and from each one, within its text.
        n, w = np.arange(len(tokens)), rule.reach
        last_bad = np.maximum.accumulate(np.where(~fits, n, -1))
        next_bad = np.minimum.accumulate(np.where(~fits, n, len(tokens))[::-1])[::-1]
        first = np.repeat(starts, lengths)
        end = np.repeat(ends, lengths)
        # Both ends of the row are tokens of the text.
        sure = (n - last_bad >= w) & (next_bad - n >= w) & (n - w >= first) & (n + w < end)
    edge = np.concatenate([[True], sure[1:] != sure[:-1]]) | begins[:-1]
    cuts = np.append(np.flatnonzero(edge), len(tokens))
    pieces, head, tail, place = [], [], [], []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if not sure[lo]:
            pieces.append(e[lo:hi])
            head.append(bool(begins[lo]))
            tail.append(bool(begins[hi]))
            place.append(lo)
    found: dict[int, list[int]] = {}
    for lo, y in zip(place, viterbi(model, pieces, head, tail), strict=True):
        if (y != O).any():
            text = int(np.searchsorted(ends, lo, side="right"))
            labels = found.setdefault(text, [O] * int(lengths[text]))
            at = lo - int(starts[text])
            labels[at : at + len(y)] = y.tolist()
    return sorted(found.items())


def tag_texts(model: Model, texts: list[str | None], rule: Clear | None) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the entities of each text, ends exclusive, without punctuation at their ends."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for n, labels in label_texts(model, texts, rule):
        open_kind = None
        for m, y in zip(TOKEN.finditer(texts[n]), labels, strict=True):
            if y == O:
                open_kind = None
                continue
            kind, begins = LABELS[y][2:], LABELS[y][0] == "B"
            core = m[0].strip(EDGE) or m[0]
            lo = m.start() + m[0].index(core)
            hi = lo + len(core)
            if not begins and open_kind == kind:
                out[n][-1] = (out[n][-1][0], hi, kind)
            else:
                out[n].append((lo, hi, kind))
            open_kind = kind
    return out


def learn(rows: list[tuple[list[str], list[str]]] | None = None) -> tuple[Model, Clear | None]:
    """The model of a labelled table, by default this package's, and the rule that holds for it."""
    if rows is None:
        return _own()
    model = train(rows)
    return model, clear_rule(model, [[t for t, y in zip(tokens, tags, strict=True) if y == "O" and not TELLING.search(t)] for tokens, tags in rows])


@lru_cache(1)
def _own() -> tuple[Model, Clear | None]:
    return learn(labelled_rows())


def tag(docs: DataFrame, rows: list[tuple[list[str], list[str]]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, value) for every entity of every document; places count characters from 0.

    ``rows`` is the labelled table; by default it is the one of this package, which has e-mail addresses, telephone
    numbers, IP addresses, card numbers and secrets. Every text is decoded whole, whatever its length. Of equal paths
    that with the lowest labels, from the end, is taken. Null and empty texts hold nothing. A null id stays null;
    repeated rows are tagged each. An empty table gives no rows. Ids keep their type. Other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rule = shared.value
        for part in chunked(batches, "text", BATCH_BYTES):
            texts = part.column("text").to_pylist()
            found = tag_texts(model, texts, rule)
            at = [i for i, x in enumerate(found) for _ in x]
            flat = [(a, b, k, texts[i][a:b]) for i, x in enumerate(found) for a, b, k in x]
            cols = list(zip(*flat, strict=True)) if flat else [[]] * 4
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at, pa.int64())), pa.array(cols[2], pa.string()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[3], pa.string())], ["id", "kind", "start", "end", "value"])

    return src.mapInArrow(run, f"id {kind}, kind string, start int, end int, value string").withColumnRenamed("id", "doc_id")


def redact(docs: DataFrame, rows: list[tuple[list[str], list[str]]] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with each entity of ``tag`` in its text replaced by its kind in brackets.

    Everything else is left alone: other columns of any name, null ids, null and empty texts, and the number of rows,
    repeated ones too. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows))

    @F.pandas_udf("string")
    def hide(texts):
        import pandas as pd

        model, rule = shared.value
        out = []
        for text, found in zip(texts, tag_texts(model, list(texts), rule), strict=True):
            for lo, hi, kind in reversed(found):
                text = f"{text[:lo]}[{kind}]{text[hi:]}"
            out.append(text)
        return pd.Series(out, dtype=object)

    text = F.col(f"`{text_col}`")
    return docs.withColumn(text_col, F.when(text.isNotNull(), hide(F.coalesce(text, F.lit("")))))
