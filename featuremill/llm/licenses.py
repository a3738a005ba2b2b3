"""License scans: a positional index of the rarest words of license templates, looked up in whole files and verified by key phrases."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

#: Rarest words of a template that are in the index, and how many of those that a file has must agree on a place.
RARE, AGREE = 6, 2
#: Words by which parts of a template may be shifted, and the share of its words that must be there.
SHIFT, COVER = 6, 0.8
_PIECE = 1 << 20

# Words are runs of digits, letters and everything beyond ASCII, A-Z in lower case.
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


@dataclass(frozen=True)
class Template:
    """A license text. Without ``keys`` the whole text must stand word for word; else each key phrase must, and most of the other words be near their places."""

    label: str
    text: str
    keys: tuple[str, ...] = ()


# Phrases that name a license.
PHRASES = (
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
)

# Usual wording of notices and grants.
NOTICES = (
    Template("agpl", "GNU Affero General Public License"),
    Template("apache-2.0", "Apache License, Version 2.0"),
    Template(
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of '
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
        "permissions and limitations under the License.",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    Template("cc-by-4.0", "CC BY 4.0"),
    Template("cc-by-nc", "CC BY-NC"),
    Template("cc-by-nc-4.0", "CC BY-NC 4.0"),
    Template("cc-by-sa", "CC BY-SA"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    Template(
        "cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
        ("dedicated all copyright and related and neighboring rights",),
    ),
    Template("gpl-2.0", "GNU General Public License, version 2"),
    Template("gpl-3.0", "GNU General Public License, version 3"),
    Template(
        "gpl-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu general public license as published by the free software foundation", "version 3 of the license"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies.",
        ("with or without fee is hereby granted",),
    ),
    Template("lgpl", "GNU Lesser General Public License"),
    Template(
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software.",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software",)),
)


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """Words of a whole text in UTF-8, in several lists when it is long."""
    start = 0
    while start < len(data):
        cut = _BREAK.search(data, start + _PIECE)
        end = cut.start() if cut else len(data)
        yield data[start:end].translate(_WORD_BYTES).split()
        start = end


def _listed(text: str) -> list[bytes]:
    return [w for words in words_of(text.encode()) for w in words]


# Index ----------------------------------------------------------------------------------------


@dataclass
class _Entry:
    """A template in the index: its words, the postings of its rarest ones (rarest first), and the places of its key phrases."""

    number: int
    words: np.ndarray
    rare: list[tuple[int, np.ndarray]]
    keys: list[tuple[int, np.ndarray]]
    shift: int
    agree: int


class Index:
    """Positional rare-word index of templates; ``idf`` weighs the words of the vocabulary."""

    def __init__(self, templates: Sequence[Template], vocabulary: dict[bytes, int], idf: np.ndarray):
        self.templates, self.vocabulary = templates, vocabulary
        self.entries: list[_Entry] = []
        for number, t in enumerate(templates):
            words = np.array([vocabulary[w] for w in _listed(t.text)], np.int32)
            keys = []
            for phrase in t.keys:
                key = np.array([vocabulary.get(w, -1) for w in _listed(phrase)], np.int32)
                at = [i for i in range(len(words) - len(key) + 1) if (words[i : i + len(key)] == key).all()]
                if not len(key) or not at:
                    raise ValueError(f"key phrase {phrase!r} is not in its template")
                keys.append((at[0], key))
            order = sorted(set(words.tolist()), key=lambda w: (-idf[w], w))
            rare = [(w, np.flatnonzero(words == w)) for w in order[: RARE if t.keys else 1]]
            self.entries.append(_Entry(number, words, rare, keys or [(0, words)], SHIFT if t.keys else 0, min(AGREE, len(rare))))
        names = {number: word for word, number in vocabulary.items()}
        #: Without any of these words a file has no match.
        self.rare = frozenset(names[w] for e in self.entries for w, _ in e.rare)

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and (template, start, share of its words in place) of every match, for one whole text."""
        n, seen = 0, False
        for words in words_of(data):
            n += len(words)
            seen = seen or not self.rare.isdisjoint(words)
        if not seen:
            return n, []
        at, base = [], 0
        for words in words_of(data):
            ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
            hit = np.flatnonzero(ids >= 0)
            at.append((hit + base, ids[hit]))
            base += len(words)
        place, word = (np.concatenate(x) for x in zip(*at))
        order = np.lexsort((place, word))
        ends = np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))
        where = [place[order[ends[w] : ends[w + 1]]] for w in range(len(self.vocabulary))]
        return n, [(e.number, s, c) for e in self.entries for s, c in self._match(e, place, word, where)]

    def _match(self, e: _Entry, place: np.ndarray, word: np.ndarray, where: list[np.ndarray]) -> list[tuple[int, float]]:
        """Starts of one template, and the share of its words there."""
        looked = [(where[w][:, None] - postings[None, :]).ravel() for w, postings in e.rare if len(where[w])]
        if len(looked) < e.agree:
            return []
        starts = np.unique(looked[0])
        for other in range(1, len(looked)):  # the rarest word of the file may be missing at this place of it
            if e.shift and len(looked) - other >= e.agree:
                starts = np.union1d(starts, looked[other])
        if e.agree > 1:
            votes = sum(_near(np.sort(offsets), starts, e.shift) for offsets in looked)
            starts = starts[votes >= e.agree]
        for at, key in e.keys:
            if len(starts) == 0:
                return []
            first = min(key.tolist(), key=lambda w: len(where[w]))
            back = int(np.flatnonzero(key == first)[0])
            starts = starts[_near(_stands(key, where[first] - back, place, word), starts + at, e.shift)]
        if not e.shift:
            return [(s, 1.0) for s in starts.tolist()]
        share = sum(_near(where[w], starts + i, e.shift) for i, w in enumerate(e.words.tolist())) / len(e.words)
        out: list[tuple[int, float]] = []
        last = None
        for s, c in zip(starts.tolist(), share.tolist()):
            if c < COVER:
                continue
            if last is not None and s - last <= 2 * e.shift:  # the same place, shifted
                out[-1] = max(out[-1], (s, c), key=lambda x: (x[1], -x[0]))
            else:
                out.append((s, c))
            last = s
        return [(max(0, s), c) for s, c in out]


def _near(places: np.ndarray, wanted: np.ndarray, shift: int) -> np.ndarray:
    """Whether one of the sorted ``places`` is within ``shift`` of each wanted one."""
    return np.searchsorted(places, wanted + shift, "right") > np.searchsorted(places, wanted - shift)


def _stands(key: np.ndarray, starts: np.ndarray, place: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Those of ``starts`` where the words of ``key`` stand one after the other."""
    i = np.searchsorted(place, starts)
    ok = i + len(key) <= len(place)
    i, starts = i[ok], starts[ok]
    for j, w in enumerate(key.tolist()):
        good = (place[i + j] == starts + j) & (word[i + j] == w)
        i, starts = i[good], starts[good]
    return starts


# Scan -----------------------------------------------------------------------------------------


def _holding(vocabulary: dict[bytes, int]):
    """Rows of (word, df) of one task's files, and (-1, files)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, files = vocabulary.keys(), Counter(), 0
        for whole in batches:
            files += whole.num_rows
            for part in slices(whole, "text", 8 << 20):
                for cell in part.column(0):
                    found: set[bytes] = set()
                    for words in words_of(cell.as_py() or b""):
                        found |= known & set(words)
                    df.update(found)
        rows = [(-1, files), *((vocabulary[w], n) for w, n in df.items())]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], ["word", "df"])

    return run


_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("words", pa.int64()), ("share", pa.float64())]))


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 8 << 20):
                counts, matches = [], []
                for cell in part.column(1):
                    n, found = index.scan(cell.as_py() or b"")
                    counts.append(n)
                    matches.append([{"label": index.templates[t].label, "template": t, "start": s, "words": len(index.entries[t].words), "share": c} for t, s, c in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(matches, _MATCHES)], ["id", "n_words", "matches"])

    return run


def build_index(docs: DataFrame, templates: Sequence[Template], text: str = "text") -> Index:
    """Index of ``templates`` whose words are weighed by the number of files of the whole table that hold them.

    What reaches the driver is a count for each word of the templates.
    """
    vocabulary: dict[bytes, int] = {}
    for t in templates:
        if not _listed(t.text):
            raise ValueError("a template needs words")
        for w in _listed(t.text):
            vocabulary.setdefault(w, len(vocabulary))
    held = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(_holding(vocabulary), "word int, df long")
    df = {r[0]: r[1] for r in held.groupBy("word").agg(F.sum("df")).collect()}
    files = df.get(-1, 0)
    idf = np.array([math.log((files + 1) / (df.get(w, 0) + 1)) for w in range(len(vocabulary))])
    return Index(templates, vocabulary, idf)


def scan(docs: DataFrame, templates: Sequence[Template] = PHRASES + NOTICES, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_words, matches) for every row: the words of the whole text and all places of the templates, as (label, template, start, words, share).

    ``template`` is the number in ``templates``, ``start`` counts words from 0. For each template a file's rarest words of it (by the
    files of the table that hold them) are looked up; their places less their places in the template must agree on a start, up to SHIFT words
    for templates with key phrases. There the key phrases must stand word for word, and ``share``, the share of the template's words
    near their places, be at least COVER; starts closer than 2 SHIFT are one match. A template without key phrases must stand word for word, and
    every such place is found, since each has the template's rarest word. The table is read twice and never shuffled.

    Null and empty texts have no words and no matches; repeated rows are scanned each for itself; an empty table gives no rows; other
    columns are not read.
    """
    index = build_index(docs, templates, text)
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = "array<struct<label:string,template:int,start:bigint,words:bigint,share:double>>"
    return rows.mapInArrow(_scan(index), f"id {kind}, n_words long, matches {found}").withColumnRenamed("id", id)
