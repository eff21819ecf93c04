"""License scans by a positional index of rare words.

Each template is a licence notice. Its words are posted with their positions. Over the corpus, the number of
documents that hold each template word gives its inverse document frequency. Of each template, the `RARE` words of
highest IDF are looked up, however common; the posting of a word at template position q, found at file position f,
votes for the template to begin at f - q. A beginning that gets the votes of a quarter of the places so posted is a
candidate, together with all that get any vote up to `SLACK` words from it, so a notice may have words put in or left
out. A candidate is verified: a share of `SHARE` of the template's words has to stand in place, and one of its
mandatory key phrases. Where notices that share words of the file are found, the one with most words in place stays. So a
key phrase alone gives no label, and a notice without one of its phrases may have another. Phrase places ("base")
are found for all files besides.

Rows: null and empty texts have no words. Repeated rows get a result each, null `doc_id`s are kept. Of words of
equal IDF the first by spelling are chosen. Long texts are scanned whole. Other columns are not looked at, so
their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

#: Phrases with the labels they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices, their labels and phrases of which one has to stand in its place.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software"
        " without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons"
        " to whom the software is furnished to do so subject to the following conditions",
        ("hereby granted free of charge", "to deal in the software without restriction"),
    ),
    (
        "mit",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind"
        " express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        ("all copies or substantial portions of the software",),
    ),
    ("apache", "licensed under the apache license version 2 0", ("apache license version 2",)),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
        " without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("apache license version 2", "www apache org licenses license 2 0"),
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
        " either version 3 of the license or at your option any later version",
        ("gnu general public license",),
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"
        " either version 2 1 of the license or at your option any later version",
        ("gnu lesser general public license",),
    ),
    (
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"
        " either version 3 of the license or at your option any later version",
        ("gnu affero general public license",),
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ("mozilla public license", "if a copy of the mpl was not distributed"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"
        " and this permission notice appear in all copies",
        ("for any purpose with or without fee",),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"
        " either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("unencumbered software released into the public domain", "for any purpose commercial or non commercial"),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ("to alter it and redistribute it freely",),
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software"
        " to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        ("person or organization obtaining a copy of the software", "use reproduce display distribute execute and transmit"),
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ("attribution noncommercial sharealike",)),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", ("attribution noncommercial noderivatives",)),
)

#: Words of a template that are looked up, and the part of their places that has to agree on a beginning.
RARE, AGREE = 8, 4
#: Words by which beginnings of one notice may differ, where some were put in or left out.
SLACK = 8
#: Least share of a template's words that has to stand in place.
SHARE = 0.7

_WORD = np.ones(256, dtype=bool)
_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def _hash(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return text.word_hashes(data, ends - np.array([len(w.encode()) for w in words]), ends)


def _file_words(column: pa.Array):
    """Lower-cased bytes, word starts and ends, first word of each row, word hashes."""
    data, offsets = text.buffers(column)
    data = text.LOWER[data]
    starts, ends, first = text.spans(data, offsets, _WORD)
    return data, starts, ends, first, text.word_hashes(data, starts, ends)


def _runs(words: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Places where the hashes `run` stand one after the other."""
    m = len(run)
    if len(words) < m:
        return np.zeros(0, np.int64)
    ok = np.ones(len(words) - m + 1, dtype=bool)
    for k in range(m):
        ok &= words[k : len(words) - m + 1 + k] == run[k]
    return np.flatnonzero(ok)


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, body, _ in templates for w in body.split()})


def document_frequency(docs: DataFrame, templates=TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of documents and, of them, how many hold each template word."""
    names = vocabulary(templates)
    hashes = _hash(names)
    order = np.argsort(hashes)

    def job(batches):
        total, seen = 0, np.zeros(len(names), np.int64)
        for batch in batches:
            for part in text.slices(batch):
                _, _, _, first, h = _file_words(part.column("text"))
                at = np.minimum(np.searchsorted(hashes[order], h), len(names) - 1)
                hit = np.flatnonzero(hashes[order][at] == h)
                row = np.searchsorted(first, hit, side="right") - 1
                seen += np.bincount(np.unique(np.stack([row, at[hit]]), axis=1)[1], minlength=len(names)) if len(hit) else 0
                total += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([-1, *order.tolist()], pa.int32()), pa.array([total, *seen.tolist()], pa.int64())], ["word", "n"])

    sums = docs.select("text").mapInArrow(job, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each template word
    found = {r["word"]: r["n"] for r in sums}
    return found.get(-1, 0), {names[k]: n for k, n in found.items() if k >= 0}


class Index:
    """Postings of the rarest words of each template, and what verifies a candidate."""

    def __init__(self, templates, idf: dict[str, float]):
        self.templates = templates
        names, hashes = list(idf), _hash(list(idf))
        order = np.argsort(hashes)
        self.keys = hashes[order]
        rank = {names[k]: r for r, k in enumerate(order.tolist())}
        self.bodies, self.hashes, self.posted, self.phrases = [], [], [], []
        for _, body, phrases in templates:
            words = body.split()
            chosen = sorted(set(words), key=lambda w: (-idf[w], w))[:RARE]
            self.bodies.append(words)
            self.hashes.append(_hash(words))
            self.posted.append([(rank[w], q) for q, w in enumerate(words) if w in chosen])
            places = [(q, p.split()) for p in phrases for q in range(len(words)) if words[q : q + len(p.split())] == p.split()]
            self.phrases.append(places)

    def candidates(self, k: int, held: list[np.ndarray], first: np.ndarray) -> list[tuple[int, list[int]]]:
        """Row and beginnings of each candidate of template `k`; `held` are the file positions of each word of `keys`."""
        votes, rows = [], []
        for word, q in self.posted[k]:
            at = held[word]
            votes.append(at - q)
            rows.append(np.searchsorted(first, at, side="right") - 1)
        places, counts = np.unique(np.stack([np.concatenate(rows), np.concatenate(votes)]), axis=1, return_counts=True)
        order = places[0] * (places[1].max(initial=0) - places[1].min(initial=0) + 2 * SLACK + 2) + places[1]  # rows apart
        out: list[tuple[int, list[int]]] = []
        last = None
        for at in np.flatnonzero(AGREE * counts >= len(self.posted[k])).tolist():
            if last is None or order[at] - last > SLACK:
                last = int(order[at])
                a, b = np.searchsorted(order, [last - SLACK, last + SLACK + 1])
                out.append((int(places[0, at]), places[1, a:b].tolist()))
        return out

    def in_place(self, k: int, begins: list[int], h: np.ndarray, low: int, high: int) -> tuple[float, set[int]]:
        """Share of the words of template `k` in place at one of the beginnings, and their file positions between `low` and `high`."""
        body = self.hashes[k]
        found, places = np.zeros(len(body), dtype=bool), set()
        for b in begins:
            q = np.arange(max(0, low - b), max(0, min(len(body), high - b)))
            hit = q[h[b + q] == body[q]]
            found[hit] = True
            places.update((b + hit).tolist())
        return float(found.mean()), places


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """`doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score` of every document.

    `score` is the best share of a found template's words that stand in their place, and 0.5 at least
    where a base phrase stands.
    """
    total, frequency = document_frequency(docs, templates)
    index = Index(templates, {w: math.log((1 + total) / (1 + frequency.get(w, 0))) for w in vocabulary(templates)})
    phrases = [(p.split(), label) for p, label in PHRASES.items()]
    phrase_hash = [_hash(p) for p, _ in phrases]

    def job(batches):
        for batch in batches:
            for part in text.slices(batch):
                data, starts, ends, first, h = _file_words(part.column("text"))
                raw = data.tobytes()
                word = lambda k: raw[starts[k] : ends[k]].decode("utf-8", "replace")  # noqa: B023, E731
                n = part.num_rows
                base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
                for (spelled, label), hs in zip(phrases, phrase_hash, strict=True):
                    m = len(hs)
                    for a in _runs(h, hs):
                        row = int(np.searchsorted(first, a, side="right")) - 1
                        if a + m <= first[row + 1] and [word(a + k) for k in range(m)] == spelled:
                            base[row].append((int(a - first[row]), label))
                extra: list[list[tuple[int, float, str, set[int]]]] = [[] for _ in range(n)]
                at = np.minimum(np.searchsorted(index.keys, h), len(index.keys) - 1)
                hit = np.flatnonzero(index.keys[at] == h)
                hit = hit[np.argsort(at[hit], kind="stable")]
                cut = np.searchsorted(at[hit], np.arange(len(index.keys) + 1))
                held = [hit[cut[k] : cut[k + 1]] for k in range(len(index.keys))]
                for k, (label, _, _) in enumerate(templates):
                    for row, begins in index.candidates(k, held, first):
                        low, high = int(first[row]), int(first[row + 1])
                        share, places = index.in_place(k, begins, h, low, high)
                        stands = lambda b, q, key: low <= b + q and b + q + len(key) <= high and [word(b + q + i) for i in range(len(key))] == key  # noqa: B023, E731
                        if share >= SHARE and any(stands(b, q, key) for b in begins for q, key in index.phrases[k]):
                            extra[row].append((-len(places), -share, label, places))
                score, labels = np.array([0.5 if b else 0.0 for b in base]), []
                for row in range(n):
                    taken: set[int] = set()
                    own = [x for _, x in base[row]]
                    for _, share, label, places in sorted(extra[row], key=lambda x: x[:3]):
                        if taken.isdisjoint(places):  # else a notice with more words in place stands here
                            taken |= places
                            own.append(label)
                            score[row] = max(score[row], -share)
                    labels.append(own)
                join = lambda x: ",".join(sorted(set(x)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(first)),
                        pa.array([len(b) for b in base], pa.int64()),
                        pa.array([min(b)[0] if b else None for b in base], pa.int64()),
                        pa.array([max(b)[0] if b else None for b in base], pa.int64()),
                        pa.array([join(x for _, x in b) for b in base], pa.string()),
                        pa.array([join(x) for x in labels], pa.string()),
                        pa.array(score),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(job, schema)
