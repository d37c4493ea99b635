"""License scans: matching statistics of document words against a suffix automaton of license templates."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Labels, and the wording of public licenses and their notices, one template per paragraph.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"""),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

LONG_MATCH = 4
LARGEST_GAP = 12
#: Bytes of templates that a task may hold: the automaton takes a few hundred bytes a word.
MOST_TEMPLATE_BYTES = 4 << 20
LEAST_COVERAGE = 0.6

#: Everything but digits, letters and bytes beyond ASCII separates words; A-Z become lower case.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_OTHER = "\0"


class SuffixAutomaton:
    """All runs of words of a set of templates; ``places[state]`` has the (template, end) of the runs that lead to the state."""

    def __init__(self, templates: list[str]):
        self.steps: list[dict[str, int]] = [{}]
        self.suffix, self.length = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]
        for number, words in enumerate(templates):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                self.places[last].add((number, at + 1))
        for state in sorted(range(1, len(self.steps)), key=self.length.__getitem__, reverse=True):
            self.places[self.suffix[state]] |= self.places[state]

    def _state(self, length: int, steps: dict[str, int], suffix: int) -> int:
        self.steps.append(steps)
        self.length.append(length)
        self.suffix.append(suffix)
        self.places.append(set())
        return len(self.steps) - 1

    def _split(self, source: int, word: str) -> int:
        """The state for ``source`` and ``word`` whose longest run is one word longer than that of ``source``."""
        target = self.steps[source][word]
        if self.length[target] == self.length[source] + 1:
            return target
        copy = self._state(self.length[source] + 1, dict(self.steps[target]), self.suffix[target])
        self.suffix[target] = copy
        while source >= 0 and self.steps[source].get(word) == target:
            self.steps[source][word] = copy
            source = self.suffix[source]
        return copy

    def _extend(self, last: int, word: str) -> int:
        if word in self.steps[last]:
            return self._split(last, word)
        state = self._state(self.length[last] + 1, {}, 0)
        source = last
        while source >= 0 and word not in self.steps[source]:
            self.steps[source][word] = state
            source = self.suffix[source]
        if source >= 0:
            self.suffix[state] = self._split(source, word)
        return state

    def matches(self, words: str):
        """``(end, length, state)`` of the longest template run that ends at each place and can't be continued, in order."""
        state = length = 0
        for at, word in enumerate(words):
            if word not in self.steps[state]:
                if length:
                    yield at, length, state
                while state and word not in self.steps[state]:
                    state = self.suffix[state]
                    length = self.length[state]
            if word in self.steps[state]:
                state = self.steps[state][word]
                length += 1
            else:
                state = length = 0
        if length:
            yield len(words), length, state


class Scanner:
    """Scans one text after the other; the vocabulary of templates and phrases is coded as one character per word."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        split = [(label, words) for label, text in templates if (words := text.encode().translate(_TABLE).split())]
        asked = [(p.encode().translate(_TABLE).split(), label) for p, label in phrases.items()]
        vocabulary = dict.fromkeys(w for words, _ in [*[(w, x) for x, w in split], *asked] for w in words)
        # One character per word, none of them a surrogate.
        self.code = {w: chr(256 + n if n < 0xD700 else n + 0x900) for n, w in enumerate(vocabulary)}
        self.labels = [label for label, _ in split]
        coded = ["".join(self.code[w] for w in words) for _, words in split]
        self.sizes = [len(c) for c in coded]
        self.automaton = SuffixAutomaton(coded)
        self.phrases = [("".join(self.code[w] for w in words), label) for words, label in asked if words]
        self.runs = re.compile(f"[^{_OTHER}]{{{LONG_MATCH},}}").finditer

    def scan(self, text: str) -> dict:
        words = text.encode().translate(_TABLE).split()
        code = self.code.get
        coded = "".join([code(w, _OTHER) for w in words])
        found, labels = [], set()
        for phrase, label in self.phrases:
            at = coded.find(phrase)
            while at >= 0:
                found.append(at)
                labels.add(label)
                at = coded.find(phrase, at + 1)
        spans = self._spans(coded)
        best = max((s["coverage"] for s in spans), default=0.0)
        return {
            "n_words": len(words),
            "n_base": len(found),
            "first_word": min(found, default=None),
            "last_word": max(found, default=None),
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {s["label"] for s in spans})),
            "score": 1.0 if found else best,
            "spans": spans,
        }

    def _spans(self, coded: str) -> list[dict]:
        """Spans of templates covered to ``LEAST_COVERAGE``: long matches of one template in order, with small gaps between."""
        chains: dict[int, list[int]] = {}
        spans = []

        def close(number: int) -> None:
            begin, end, _, covered = chains.pop(number)
            if covered >= LEAST_COVERAGE * self.sizes[number]:
                spans.append({"label": self.labels[number], "template": number, "first_word": begin, "last_word": end - 1, "coverage": covered / self.sizes[number]})

        for run in self.runs(coded):
            for end, length, state in self.automaton.matches(run.group()):
                if length < LONG_MATCH:
                    continue
                begin, end = run.start() + end - length, run.start() + end
                places: dict[int, list[int]] = {}
                for number, to in self.automaton.places[state]:
                    places.setdefault(number, []).append(to)
                for number, ends in places.items():
                    chain = chains.get(number)
                    if chain:
                        follows = [to for to in ends if to > chain[2]]
                        if begin - chain[1] <= LARGEST_GAP and follows:
                            to = min(follows)
                            chain[3] += min(length, to - chain[2])
                            chain[1:3] = [end, to]
                            continue
                        close(number)
                    chains[number] = [begin, end, min(ends), length]
        for number in list(chains):
            close(number)
        return sorted(spans, key=lambda s: (s["first_word"], s["template"]))


_RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, template: long, first_word: long, last_word: long, coverage: double>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))


def templates_of(table: DataFrame) -> list[tuple[str, str]]:
    """Templates from rows ``(label, text)``, at most ``MOST_TEMPLATE_BYTES`` of text, as every task holds them all."""
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates; a task holds {MOST_TEMPLATE_BYTES} at most")
    return [(r["label"], r["text"]) for r in table.select("label", "text").where("label IS NOT NULL AND text IS NOT NULL").distinct().orderBy("label", "text").collect()]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """License places and spans per document, over whole texts, without a shuffle.

    ``templates`` are pairs of label and wording, ``phrases`` wordings with their labels; both may be given as plain text.

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. ``n_base`` counts all places of ``PHRASES``,
    ``first_word`` and ``last_word`` are the smallest and largest of their first words. Words stream through a suffix automaton of
    all templates, which gives the longest template run that ends at each word; runs of ``LONG_MATCH`` words or more are chained
    per template, in order and with at most ``LARGEST_GAP`` words between, and a chain that covers ``LEAST_COVERAGE`` of its
    template is a span. ``labels`` are those of phrases and spans; ``score`` is 1 with a phrase, else the best span's coverage.

    A null or empty text has no words, empty labels, null places and score 0. Null keys and repeated rows are scanned like others;
    other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        scanner = Scanner(templates, phrases)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                got = [scanner.scan(t or "") for t in rows.column("_text").to_pylist()]
                columns = [pa.array([g[c] for g in got], t) for c, t in (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPAN))]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, f"doc_id {kind}, {_RESULT}")
