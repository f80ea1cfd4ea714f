"""Licence scan by a positional index of rare words.

Templates are word sequences.  The index keeps, for each licence word that is rare in the corpus or among
the rarest of a template, its places in all templates.  A file looks up all of its rare licence words; every (word place, template place)
pair votes for an alignment, and templates whose votes agree on a relative position are verified:
the words at the aligned places must match, and the template's mandatory phrases must stand there.

Defined cases: a null or empty text has no words and no labels; a very long text is looked up word by word like any other; repeated rows give equal rows; ties
between alignments go to the earlier place; only the key and the text are read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievector.llm.batches import arrow_map, pieces, texts_of

# Phrases that name a licence by themselves.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Passages, notices and whole texts of public licences (label, text, mandatory phrases).
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["hereby granted free of charge", "without restriction"]),
    ("mit", "released under the MIT License", ["mit license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ["apache license version 2"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["apache license version 2"]),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ["gnu general public license", "version 2"]),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu general public license", "version 3"]),
    ("gpl-2", "licensed under the GNU General Public License, version 2", ["general public license version 2"]),
    ("gpl-3", "licensed under the GNU General Public License, version 3", ["general public license version 3"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3", ["gnu affero general public license"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ["mozilla public license v 2"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial International License", ["attribution noncommercial"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike International License", ["attribution sharealike"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution International License", ["creative commons attribution international"]),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ["unencumbered software released into the public domain"]),
    ("boost-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["person or organization obtaining a copy"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
]

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_WHOLE = [
    ("mit", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ["hereby granted free of charge", "substantial portions of the software"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", ["with or without fee is hereby granted", "disclaims all warranties"]),
    ("bsd-2-clause", f"{_BSD_TWO} {_BSD_END}", ["redistribution and use in source and binary forms", "even if advised of the possibility"]),
    ("bsd-3-clause", f"{_BSD_TWO} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}", ["redistribution and use in source and binary forms", "endorse or promote products"]),
    ("boost-1", f"Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. {_AS_IS}, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ["person or organization obtaining a copy", "source language processor"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ["in no event will the authors be held liable", "altered source versions"]),
]
TEMPLATES += _WHOLE

#: Bytes that end words become spaces and A-Z small letters; all other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of letters, digits and all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which ``phrase`` starts; ``joined`` has one space before, between and after words."""
    found, at, spaces, seen = [], joined.find(phrase), 0, 0
    while at >= 0:
        spaces += joined.count(b" ", seen, at)
        seen = at
        found.append(spaces)
        at = joined.find(phrase, at + 1)
    return found


@dataclass
class Index:
    """Postings of licence words; ``idf`` has the words that are rare enough to look up."""

    idf: dict[bytes, float]
    counted: int = 24  # rare words of a template of which a share must agree, at most
    agree: float = 0.6  # share of a template's rare words that must agree on a position
    slack: int = 6  # words by which an edited copy may shift
    match: float = 0.7  # share of a template's words that must stand at the aligned places
    words: list[list[bytes]] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    keys: list[list[bytes]] = field(default_factory=list)
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    rare: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        for label, text, keys in TEMPLATES:
            t, words = len(self.words), words_of(text)
            self.words.append(words)
            self.labels.append(label)
            self.keys.append([b" " + k.encode() + b" " for k in keys])
            for q, w in enumerate(words):
                if w in self.idf:
                    self.postings[w].append((t, q))
            self.rare.append(len({w for w in words if w in self.idf}))

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share of the template that matches) of each verified alignment."""
        here = self.postings.keys() & set(words)
        if not here:
            return []
        votes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in here:
                for t, q in self.postings[w]:
                    votes[t].append((p - q, w))
        found = []
        for t, cast in votes.items():
            cast.sort()
            need = max(1, math.ceil(self.agree * min(self.rare[t], self.counted)))
            lo, last = 0, -1 << 60
            inside: dict[bytes, int] = defaultdict(int)
            for at, w in cast:  # a window of ``slack`` over the sorted relative positions
                inside[w] += 1
                while cast[lo][0] < at - self.slack:
                    gone = cast[lo][1]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                    lo += 1
                if len(inside) >= need and cast[lo][0] > last + self.slack:
                    if hit := self._verify(t, cast[lo][0], words):
                        found.append(hit)
                        last = cast[lo][0]
        return found

    def _verify(self, t: int, at: int, words: list[bytes]) -> tuple[str, int, int, float] | None:
        template = self.words[t]
        start, end = max(0, at), min(len(words), at + len(template) + self.slack)
        part = words[start:end]
        joined = b" " + b" ".join(part) + b" "
        if any(k not in joined for k in self.keys[t]) or (share := _common(template, part) / len(template)) < self.match:
            return None
        return self.labels[t], start, min(end, start + len(template)) - 1, share


def _common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence of two short word lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            above = row[j + 1]
            row[j + 1] = max(above, row[j]) if x != y else left + 1
            left = above
    return row[-1]


def licence_words() -> list[bytes]:
    return sorted({w for _, text, _ in TEMPLATES for w in words_of(text)})


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Documents, and how many of them have each licence word; at most one row a word reaches the driver."""
    vocabulary = {w: i for i, w in enumerate(licence_words())}

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = [0] * len(vocabulary), 0
        known = set(vocabulary)
        for batch in pieces(batches):
            for text in texts_of(batch):
                rows += 1
                for w in known.intersection(words_of(text)):
                    counts[vocabulary[w]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(counts))], pa.int32()), pa.array([rows, *counts], pa.int64())], ["word", "n"])

    got = arrow_map(docs.select("text"), body, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by = {r["word"]: r["n"] for r in got}
    return by.get(-1, 0), {w: by.get(i, 0) for w, i in vocabulary.items()}


def rare_words(n_docs: int, seen: dict[bytes, int], common: float = 0.2, least: int = 8) -> dict[bytes, float]:
    """IDF of the licence words that at most a share ``common`` of the documents has.

    A group of copies makes the words of its own licence common, so each template also keeps its rarest words
    whatever their share: ``least`` of them, or as many as must agree on a position in a short template.
    """
    kept = {w for w, n in seen.items() if n <= common * n_docs or n_docs == 0}
    for _, text, _ in TEMPLATES:
        own = sorted(set(words_of(text)) & seen.keys(), key=lambda w: (seen[w], w))
        kept.update(own[: min(least, math.ceil(Index.agree * len(own)))])
    return {w: math.log((n_docs + 1) / (seen[w] + 1)) + 1e-9 for w in sorted(kept)}


SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, spans): each place of a base phrase, and each verified template."""
    idf = docs.sparkSession.sparkContext.broadcast(rare_words(*document_frequencies(docs)))
    phrases = [(b" " + p.encode() + b" ", len(p.split()), label) for p, label in BASE_PHRASES.items()]

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf.value)
        for batch in pieces(batches):
            counts, spans = [], []
            for text in texts_of(batch):
                words = words_of(text)
                counts.append(len(words))
                joined = b" " + b" ".join(words) + b" "
                own = [(label, at, at + n - 1, 1.0, True) for p, n, label in phrases for at in phrase_places(joined, p)]
                own += [(*x, False) for x in index.scan(words)]
                spans.append([dict(zip(("label", "first", "last", "score", "base"), x)) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(SPAN))], ["key", "n_words", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, spans array<struct<label: string, first: long, last: long, score: double, base: boolean>>"
    return arrow_map(docs.select(F.col(key).alias("key"), "text"), body, schema).withColumnRenamed("key", key)
