"""Licence scans: a positional index of rare licence words, aligned postings and mandatory phrases."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm.common import id_and_text, slices

# Phrases whose words must stand consecutively, with their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str) -> list[str]:
    """Words of the text after lower-casing A-Z: runs of digits, letters a-z and non-ASCII characters."""
    return _WORD.findall(text.translate(_LOWER))


# Wording of well-known licences, notices first, then bodies: label, template, mandatory key phrase.
_WORDING = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "www apache org licenses license 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "it under the terms of the gnu general public license version 2 as published by the free software foundation", "gnu general public license version 2"),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation either version", "gnu general public license as published"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright", "associated cc0 with this work"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
    in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
    Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
    shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
    BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
    FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
    OTHER DEALINGS IN THE SOFTWARE.""", "permission is hereby granted free of charge"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
    reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "redistributions of source code must retain the above copyright notice"),
    ("bsd", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
    WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
    INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
    PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
    ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", "provided by the copyright holders and contributors as is"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
    notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
    ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""", "the author disclaims all warranties with regard to this software"),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
    of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
    subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
    "the origin of this software must not be misrepresented"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
    software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", "unencumbered software released into the public domain"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
    the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
    distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
    permissions and limitations under the License.""", "unless required by applicable law or agreed to in writing"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
    Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
    WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "gnu general public license as published"),
)

#: The same in words.
TEMPLATES = tuple((label, " ".join(words_of(text)), key) for label, text, key in _WORDING)

def find_phrase(words: list[str], phrase: list[str]) -> list[int]:
    """Every place where the phrase's words stand consecutively."""
    first, n, out, at = phrase[0], len(phrase), [], -1
    while True:
        try:
            at = words.index(first, at + 1)
        except ValueError:
            return out
        if words[at : at + n] == phrase:
            out.append(at)


class RareWordIndex:
    """Positional postings of licence words: word -> (template, position).

    idf: inverse document frequency in the corpus of every word of the templates and base phrases. A template is
    posted under the occurrences of its highest-idf words, as many as outweigh, the heaviest left out, the share that
    a match may lack: a match has two of them in place at least. A base phrase is posted under its highest-idf word.
    """

    def __init__(self, idf: dict[str, float], templates=TEMPLATES, base=BASE_PHRASES, least: float = 0.8):
        self.idf, self.least = idf, least
        self.templates = [(label, text.split(), key.split()) for label, text, key in templates]
        self.weight = [[idf[w] for w in words] for _, words, _ in self.templates]
        self.key_at = [find_phrase(words, key)[0] for _, words, key in self.templates]
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, _) in enumerate(self.templates):
            upto, heaviest = 0.0, 0.0
            for place in sorted(range(len(words)), key=lambda i: (-self.weight[t][i], words[i], i)):  # noqa: B023
                if upto - heaviest > (1 - least) * sum(self.weight[t]):
                    break
                self.postings[words[place]].append((t, place))
                upto, heaviest = upto + self.weight[t][place], max(heaviest, self.weight[t][place])
        self.base = [(phrase.split(), label) for phrase, label in base]
        self.exact: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for p, (words, _) in enumerate(self.base):
            place = min(range(len(words)), key=lambda i: (-idf[words[i]], i))
            self.exact[words[place]].append((p, place))
        self.vocabulary = frozenset(self.postings) | frozenset(self.exact)

    def scan(self, words: list[str]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """(place, label) of every base phrase, and label -> best idf-weighted share of a template in place around its key phrase.

        The text's own licence words are looked up from the highest idf down; their postings vote for places, by the
        word's position less the template's. A place with two votes is verified: the key phrase whole, then the share.
        """
        base: list[tuple[int, str]] = []
        found: dict[str, float] = {}
        present = self.vocabulary.intersection(words)
        if not present:
            return base, found
        places: dict[str, list[int]] = {w: [] for w in present}
        for place, word in enumerate(words):
            if word in present:
                places[word].append(place)
        votes: Counter = Counter()
        for word in sorted(present, key=lambda w: (-self.idf[w], w)):
            for p, offset in self.exact.get(word, ()):
                phrase, label = self.base[p]
                base += [(place - offset, label) for place in places[word] if place >= offset and words[place - offset : place - offset + len(phrase)] == phrase]
            for t, offset in self.postings.get(word, ()):
                votes.update([(t, place - offset) for place in places[word]])
        for (t, start), n in votes.items():
            label, wanted, key = self.templates[t]
            at = start + self.key_at[t]
            if n < 2 and len(wanted) > 1 or at < 0 or words[at : at + len(key)] != key:
                continue
            weight = self.weight[t]
            hit = sum(weight[i] for i, w in enumerate(wanted) if 0 <= start + i < len(words) and words[start + i] == w)
            share = hit / sum(weight)
            if share >= self.least:
                found[label] = max(found.get(label, 0.0), share)
        return base, found


def licence_idf(texts: DataFrame, templates=TEMPLATES, base=BASE_PHRASES) -> dict[str, float]:
    """Smoothed inverse document frequency, over all documents, of the words of templates and base phrases.

    Each task sends one count for each template word it met, so the driver gets at most as many rows as
    the templates have words: fixed, whatever the corpus.
    """
    vocabulary = frozenset(w for _, text, _ in templates for w in text.split()) | frozenset(w for phrase, _ in base for w in phrase.split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, frequency = 0, Counter()
        for _, rows in slices(batches):
            n += len(rows)
            for text in rows:
                frequency.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict({"word": ["", *frequency], "n": [n, *frequency.values()]}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = {r["word"]: r["n"] for r in rows}
    total = frequency.get("", 0)
    return {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) + 1e-9 for w in sorted(vocabulary)}


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE_PHRASES, least: float = 0.8) -> DataFrame:
    """Licence labels of every whole text.

    Two narrow passes: one counts the licence words over the corpus, one scans. Each text looks up its own highest-idf
    licence words in ``RareWordIndex``, whose postings are aligned by position. A base phrase counts wherever its words
    stand consecutively. A template adds its label where its key phrase stands exactly in place and words worth
    ``least`` of its idf are in place.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a base phrase,
    else the best share). Null and empty texts have no words, empty labels and score 0; very long texts are scanned
    whole; repeated rows are scanned each; a null id stays null; an empty table gives an empty result; other columns
    are ignored.
    """
    texts = id_and_text(docs, id_col, text_col)
    idf = licence_idf(texts, templates, base)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RareWordIndex(idf, templates, base, least)
        for ids, rows in slices(batches):
            out: list[tuple] = []
            for text in rows:
                words = words_of(text)
                phrases, found = index.scan(words)
                places, labels = [place for place, _ in phrases], {label for _, label in phrases}
                score = 1.0 if labels else max(found.values(), default=0.0)
                out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(found))), min(1.0, round(score, 9))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return texts.mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
