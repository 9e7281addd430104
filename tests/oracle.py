"""A plain evaluator of the search semantics, written for tests only."""

import math
import re
import struct

import regex


def toks(t):
    return regex.split(r"[\n\r\p{Z}\p{P}]+", t)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


class Index:
    def __init__(self, docs, fields):
        self.fields, self.ids, self.n = fields, [d["id"] for d in docs], len(docs)
        self.post, self.len = {}, {}
        avg = [0.0] * len(fields)
        for i, d in enumerate(docs):
            for f, name in enumerate(fields):
                if d.get(name) is None:
                    continue
                raw = toks(str(d[name]))
                self.len[i, f] = len(set(raw))
                avg[f] = (avg[f] * i + len(set(raw))) / (i + 1)
                for t in raw:
                    if t:
                        p = self.post.setdefault(t.lower(), {}).setdefault(f, {})
                        p[i] = p.get(i, 0) + 1
        self.avg = [struct.unpack("f", struct.pack("f", a))[0] for a in avg]

    def spec(self, q, prefix, k, fields, boost, weights=(0.375, 0.45)):
        out = {}
        for t in self.post:
            length = len(t)
            if t == q:
                w = 1.0
            elif prefix and t.startswith(q):
                w = weights[0] * length / (length + 0.3 * (length - len(q)))
            elif k and 1 <= (e := lev(t, q)) <= k:
                w = weights[1] * length / (length + e)
            else:
                continue
            for f, docs in self.post[t].items():
                if self.fields[f] not in fields:
                    continue
                idf = math.log(1 + (self.n - len(docs) + 0.5) / (len(docs) + 0.5))
                for d, tf in docs.items():
                    s = idf * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 / self.avg[f] * self.len[d, f])))
                    r = out.setdefault(d, [0.0, [q], set()])
                    r[0] += w * (boost.get(self.fields[f]) or 1) * s
                    r[2].add(t)
        return out

    def run(self, q, o):
        if isinstance(q, tuple):
            passed = {**o, **q[1]}
            parts = [self.run(x, passed) for x in q[0]]
            return self.combine(parts, passed.get("combine_with", "or"))
        terms = [t.lower() for t in toks(q) if t]
        parts = []
        for t in terms:
            f = o.get("fuzzy") or 0
            f = 0.2 if f is True else f
            k = min(6, math.floor(len(t) * f + 0.5)) if f < 1 else int(f)
            parts.append(self.spec(t, o.get("prefix", False), k, o.get("fields", self.fields), o.get("boost", {})))
        return self.combine(parts, o.get("combine_with", "or"))

    def combine(self, parts, op):
        if not parts:
            return {}
        a = {d: [s, list(q), set(m)] for d, (s, q, m) in parts[0].items()}
        for b in parts[1:]:
            if op == "and_not":
                a = {d: v for d, v in a.items() if d not in b}
                continue
            if op == "and":
                a = {d: v for d, v in a.items() if d in b}
            for d, (s, q, m) in b.items():
                if d in a:
                    a[d][0] += s
                    a[d][1] += [x for x in q if x not in a[d][1]]
                    a[d][2] |= m
                elif op == "or":
                    a[d] = [s, list(q), set(m)]
        return a

    def search(self, q, **o):
        return {self.ids[d]: (s * max(1, len(t)), frozenset(m)) for d, (s, t, m) in self.run(q, o).items()}


def words(r, n):
    return " ".join(r.choice("alpha beta gamma delta epsilon alphabet betamax gam delt Alp zeta, eta; theta".split()) for _ in range(n))


def strip(s):
    return re.sub(r"\s+", " ", s)
