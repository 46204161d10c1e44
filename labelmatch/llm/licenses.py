"""License scans with a positional rare-token index.

Document frequencies of all template words are counted over the whole corpus. The index holds, for each word of a
template's key phrases, the places where it stands in the template. A file's licence words are ranked by their inverse
document frequency, highest first; their postings say where a template would begin, which may be before the file, and
the postings of the next words are intersected with these by relative position. What is left is a candidate; it is
kept if all of the template's key phrases stand at their places there. Its score is the share of the template's words
that stand in place. No file's words are cut off: a template is left out of account only if a word of its key phrases is
not in the file at all.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of lower-cased UTF-8: bytes outside the ranges 00-2F, 3A-60 and 7B-7F.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# ---- fixed values: phrases and licence texts -----------------------------------------------
#: Phrases whose places are always reported, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: label, text, key phrases that must stand at their place in it.
TEMPLATES = [
    ("mit-notice", "released under the MIT license", ["mit license"]),
    (
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
        FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        ["for any purpose with or without fee is hereby granted"],
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        ["redistribution and use in source and binary forms", "conditions are met"],
    ),
    (
        "bsd-3-clause",
        """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission.""",
        ["redistributions in binary form must reproduce", "endorse or promote products"],
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as
        being the original software. 3. This notice may not be removed or altered from any source distribution.""",
        ["must not be misrepresented", "altered source versions"],
    ),
    (
        "bsl-1.0",
        """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and
        to permit third-parties to whom the Software is furnished to do so, all subject to the following:""",
        ["boost software license"],
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
        code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ["unencumbered software", "public domain"],
    ),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.", ["you want to public license"]),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ["apache license", "version 2 0"],
    ),
    ("gpl-3.0", "this work is licensed under the GNU General Public License version 3", ["gnu general public license", "version 3"]),
    (
        "gpl-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3
        of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with
        this program. If not, see <https://www.gnu.org/licenses/>.""",
        ["gnu general public license as published", "either version 3"],
    ),
    (
        "gpl-2.0-or-later",
        """under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        ["gnu general public license", "either version 2"],
    ),
    ("lgpl", "GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl", "GNU Affero General Public License", ["affero general public license"]),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""",
        ["mozilla public license"],
    ),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under CC BY 4.0", ["cc by 4 0"]),
]
# ---- end of fixed values -------------------------------------------------------------------
#: How many of a template's rarest words in a file are intersected before its key phrases are looked for.
RARE = 3


def words_of(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z, in UTF-8; none for null."""
    return WORD.findall((text or "").encode().lower())


BASE = {tuple(words_of(p)): label for p, label in PHRASES.items()}


def _find(words: list[bytes], phrase: tuple[bytes, ...]) -> list[int]:
    places, at = [], -1
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if tuple(words[at : at + len(phrase)]) == phrase:
                places.append(at)
    except ValueError:
        return places


@dataclass
class Index:
    """Labels and words of the templates; of each its key phrases with their places; inverse document frequencies; word -> template -> places."""

    labels: list[str]
    texts: list[list[bytes]]
    keys: list[list[tuple[tuple[bytes, ...], list[int]]]]
    idf: dict[bytes, float]
    postings: dict[bytes, dict[int, list[int]]]


def vocabulary(templates: list[tuple[str, str, list[str]]]) -> set[bytes]:
    return {w for _, _, keys in templates for k in keys for w in words_of(k)}


def document_frequencies(docs: DataFrame, words: set[bytes], text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """How many rows there are, and in how many each of ``words`` stands, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        for batch in batches:
            n += len(batch)
            for text in batch.column(0):
                counts.update(words.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([b"", *counts], pa.binary()), pa.array([n, *counts.values()], pa.int64())], names=["word", "n"])

    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {bytes(r["word"]): r["n"] for r in sums.collect()}  # a row for each word of the key phrases
    return found.pop(b"", 0), found


def index(templates: list[tuple[str, str, list[str]]], n_docs: int, frequencies: dict[bytes, int]) -> Index:
    texts = [words_of(text) for _, text, _ in templates]
    keys = [[(k, _find(words, k)) for k in (tuple(words_of(k)) for k in phrases)] for words, (_, _, phrases) in zip(texts, templates, strict=True)]
    postings: dict[bytes, dict[int, list[int]]] = defaultdict(dict)
    for t, phrases in enumerate(keys):
        for at in sorted({p + i for k, places in phrases for p in places for i in range(len(k))}):
            postings[texts[t][at]].setdefault(t, []).append(at)
    idf = {w: math.log((n_docs + 1) / (frequencies.get(w, 0) + 1)) for w in postings}
    return Index([label for label, _, _ in templates], texts, keys, idf, dict(postings))


def match(words: list[bytes], known: Index) -> list[tuple[str, int, float]]:
    """``(label, start, score)`` of each place where a template's key phrases stand; it starts at 0 if words before them are cut off."""
    places: dict[bytes, list[int]] = defaultdict(list)
    for at, w in enumerate(words):
        if w in known.postings:
            places[w].append(at)
    could = {t for t, keys in enumerate(known.keys) if all(w in places for k, _ in keys for w in k)}
    starts: dict[int, set[int]] = {}
    used: Counter = Counter()
    for w in sorted(places, key=lambda w: (-known.idf[w], w)) if could else ():
        for t, spots in known.postings[w].items():
            if t in could and used[t] < RARE:
                used[t] += 1
                here = {at - p for at in places[w] for p in spots}
                starts[t] = starts[t] & here if t in starts else here
    out = []
    for t, found in sorted(starts.items()):
        wanted = known.texts[t]
        for start in sorted(found):
            here = [b""] * -start + words[max(start, 0) : max(start + len(wanted), 0)]
            if all(any(tuple(here[p : p + len(k)]) == k for p in spots) for k, spots in known.keys[t]):
                out.append((known.labels[t], max(start, 0), sum(a == b for a, b in zip(here, wanted, strict=False)) / len(wanted)))
    return out


def scan(docs: DataFrame, templates=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, phrases array<struct<label, start>>, licenses array<struct<label, start, score>>)`` for each row.

    Null and empty texts have no words; repeated rows give repeated rows; no rows give no rows; further columns are
    ignored; texts of any length are searched whole; places where several templates stand are reported for each.
    """
    templates = TEMPLATES if templates is None else templates
    known = index(templates, *document_frequencies(docs, vocabulary(templates), text_col))
    firsts = [frozenset(w for k, _ in keys for w in k) for keys in known.keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, phrases, licenses = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                sizes.append(len(words))
                met = set(words)
                phrases.append([{"label": label, "start": at} for phrase, label in BASE.items() if met.issuperset(phrase) for at in _find(words, phrase)])
                found = match(words, known) if any(map(met.issuperset, firsts)) else []
                licenses.append([{"label": x, "start": at, "score": s} for x, at, s in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(phrases, one), pa.array(licenses, two)], names=["id", "n_words", "phrases", "licenses"])

    one = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    two = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64())]))
    place = T.StructType().add("label", "string").add("start", "long")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("phrases", T.ArrayType(place)), T.StructField("licenses", T.ArrayType(T.StructType([*place.fields, T.StructField("score", T.DoubleType())])))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op6_license(docs: DataFrame) -> DataFrame:
    """score: the best template's share of words in place, or 0.5 if only a base phrase stands, or 0."""
    base = F.array_sort(F.array_distinct(F.col("phrases.label")))
    found = F.array_sort(F.array_distinct(F.concat("phrases.label", "licenses.label")))
    best = F.coalesce(F.array_max("licenses.score"), F.lit(0.0))
    return scan(docs).select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.start").alias("first_word"),
        F.array_max("phrases.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(found, ",").alias("labels"),
        F.greatest(best, F.when(F.size("phrases") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
