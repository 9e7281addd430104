"""Licence scans by a positional index of rare words.

Licence words are weighed by their inverse document frequency in the corpus. Of each template, the rarest words are
indexed with their places: so many that text with the wanted share of the template must have one of them. A file looks
up its words in the index; where a posting is met, the postings of the template's other words are intersected by
relative position. A word is in its place if it stands where the template would have it, or so few words away as the
length of the template allows, so words may be put in or left out. What has enough words in place is verified by the
mandatory phrases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD


@dataclass(frozen=True)
class Template:
    license: str
    text: str
    #: Word sequences that have to stand within the match.
    phrases: tuple[str, ...]


_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version"
_CC = "This work is licensed under a Creative Commons Attribution{0} {1} International License"
_SPDX = ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "BSL-1.0", "Zlib")
TEMPLATES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache license", "in compliance with the license")),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004", ("apache license", "january 2004")),
    Template("MIT", "Released under the MIT License", ("mit license",)),
    Template("MIT", "This project is licensed under the terms of the MIT license", ("mit license",)),
    Template("MIT", _MIT, ("permission is hereby granted", "free of charge")),
    Template("MIT", _MIT + " (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", ("permission is hereby granted", "sublicense and or sell copies")),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license", "version 3")),
    Template("GPL-3.0", _GPL.format("", "3"), ("gnu general public license", "version 3")),
    Template("GPL-2.0", _GPL.format("", "2"), ("gnu general public license", "version 2")),
    Template("LGPL-3.0", _GPL.format("Lesser ", "3"), ("gnu lesser general public license", "version 3")),
    Template("LGPL-2.1", _GPL.format("Lesser ", "2.1"), ("gnu lesser general public license", "version 2 1")),
    Template("AGPL-3.0", _GPL.format("Affero ", "3"), ("gnu affero general public license", "version 3")),
    Template("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ("gnu general public license", "29 june 2007")),
    Template("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", ("gnu general public license", "june 1991")),
    Template("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", ("gnu affero general public license", "19 november 2007")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "2 0")),
    Template("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use", "are permitted")),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee", "is hereby granted")),
    Template("Unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("provided as is", "in no event will the authors")),
    Template("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", ("boost software license",)),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    Template("WTFPL", "Do What The Fuck You Want To Public License Version 2, December 2004", ("public license", "december 2004")),
    Template("Artistic-2.0", "Licensed under the Artistic License 2.0", ("artistic license 2 0",)),
    Template("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ("sil open font license", "1 1")),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("CC-BY-4.0", _CC.format("", "4.0"), ("commons attribution 4 0",)),
    Template("CC-BY-SA-4.0", _CC.format("-ShareAlike", "4.0"), ("attribution sharealike 4 0",)),
    Template("CC-BY-NC-4.0", _CC.format("-NonCommercial", "4.0"), ("attribution noncommercial 4 0",)),
    Template("CC-BY-NC-SA-4.0", _CC.format("-NonCommercial-ShareAlike", "4.0"), ("attribution noncommercial sharealike 4 0",)),
    Template("CC0-1.0", "Released under CC0 1.0 Universal public domain dedication", ("cc0 1 0",)),
    *(Template(name, f"SPDX-License-Identifier: {name}", ("spdx license identifier", " ".join(WORD.findall(name.lower())))) for name in _SPDX),
    Template("Proprietary", "All rights reserved", ("all rights reserved",)),
)
#: Share of a template's words that have to stand in their places.
COVERAGE = 0.8
#: Words of a template for each word that the others may be out of place by, and the most.
PER_SLACK, MOST_SLACK = 10, 8


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """(documents, documents with each licence word), over all documents that have a text. The words are the templates' only."""
    vocabulary = frozenset(w for t in templates for w in words_of(t.text))
    src = docs.select(F.col(f"`{text_col}`").alias("text")).where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                for w in vocabulary.intersection(WORD.findall(text.lower())):
                    df[w] += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(["", *df]), pa.array([n, *df.values()], pa.int64())], ["w", "n"])

    rows = src.mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    of = {r["w"]: r["n"] for r in rows}
    return of.pop("", 0), of


class Index:
    """Templates' words and the postings of their rarest."""

    def __init__(self, templates: tuple[Template, ...], n: int, df: dict[str, int], coverage: float):
        self.templates = templates
        self.words = [words_of(t.text) for t in templates]
        self.slack = [min(MOST_SLACK, len(w) // PER_SLACK) for w in self.words]
        self.least = [math.ceil(coverage * len(w) - 1e-9) for w in self.words]
        self.phrases = [[p.split() for p in t.phrases] for t in templates]
        self.vocabulary = {w for words in self.words for w in words}
        idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1))
        #: Templates that have the word among their rarest.
        self.postings: dict[str, set[int]] = {}
        for t, words in enumerate(self.words):
            # If none of these is in its place, too few of the others are left.
            rare = sorted(range(len(words)), key=lambda i: (-idf(words[i]), i))[: len(words) - self.least[t] + 1]
            for i in rare:
                self.postings.setdefault(words[i], set()).add(t)

    def starts(self, t: int, places: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a template may begin, with the number of its words in place and of those in their very places."""
        words, slack = self.words[t], self.slack[t]
        base = len(words) + slack  # the lowest start is -base
        near, exact = np.zeros(n + base + slack + 2, np.int64), np.zeros(n + base + slack + 2, np.int64)
        for i, w in enumerate(words):
            at = places.get(w)
            if at is None:
                continue
            at = at - i + base
            # Starts for which a place of the word is near enough; those of several places count once.
            lo, hi = np.maximum(at - slack, 0), at + slack + 1
            lo[1:] = np.maximum(lo[1:], hi[:-1])
            np.add.at(near, lo, 1)
            np.add.at(near, hi, -1)
            np.add.at(exact, at, 1)
        near = np.cumsum(near)
        start = np.flatnonzero(near >= self.least[t])
        return start - base, near[start], exact[start]

    def scan(self, text: str) -> list[tuple[str, int, float]]:
        """(licence, place of its first word, share of the words in their places), without those that lie within better ones."""
        words = words_of(text)
        met = self.postings.keys() & set(words)
        if not met:
            return []
        lists: dict[str, list[int]] = {}
        for p, w in enumerate(words):
            if w in self.vocabulary:
                lists.setdefault(w, []).append(p)
        places = {w: np.array(x) for w, x in lists.items()}
        found = []
        for t in set().union(*(self.postings[w] for w in met)):
            size, slack = len(self.words[t]), self.slack[t]
            for start, near, exact in zip(*(x.tolist() for x in self.starts(t, places, len(words))), strict=True):
                span = words[max(0, start - slack) : start + size + slack]
                if all(_within(p, span) for p in self.phrases[t]):
                    found.append((near / size, exact, size, start, t))
        found.sort(key=lambda x: (-x[2], -x[0], -x[1], x[3], x[4]))
        out, taken = [], []
        for share, _, size, start, t in found:
            if any(s < start + size and start < e for s, e in taken):
                continue
            taken.append((start, start + size))
            out.append((self.templates[t].license, start, share))
        return sorted(out, key=lambda x: (x[1], x[0]))


def _within(phrase: list[str], words: list[str]) -> bool:
    n = len(phrase)
    return any(words[i : i + n] == phrase for i in range(len(words) - n + 1))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, position, coverage) for every licence notice of every document.

    ``position`` is the number of the notice's first word in the text (it may be negative if the text begins within
    the notice). A word is in place within a tenth of the template's length, eight words at most. Of notices that
    overlap the longer stays, then the one with more words in place, then with more in their very places, then the
    earlier, then the earlier template. Texts are taken whole. Null and empty texts have none. A null id stays null, and repeated rows are scanned each. An empty table gives no
    rows. Other columns aren't read. The templates are a parameter and don't grow with the corpus.
    """
    n, df = word_frequencies(docs, templates, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, n, df, coverage))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for hit in index.scan(text):
                    at.append(i)
                    found.append(hit)
            if at:
                name, start, share = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(name), pa.array(start, pa.int32()), pa.array([round(s, 6) for s in share], pa.float64())], ["id", "license", "position", "coverage"])

    return src.mapInArrow(run, f"id {kind}, license string, position int, coverage double").withColumnRenamed("id", "doc_id")
