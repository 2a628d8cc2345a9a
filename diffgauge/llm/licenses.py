"""License scans: notices written as templates with optional and replaceable regions.

A template is license wording with markup: ``<<o>> ... <</o>>`` encloses words that may be missing, and
``<<v:regex>>`` or ``<<v:regex:max>>`` stands for one to ``max`` words that each match the expression. It is
compiled to an automaton over words; a text is accepted where the automaton reads the mandatory wording word
for word, starting at any place.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffgauge.llm.common import texts_of

# fixed values: what counts as a word, and the phrases with their labels
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
LOWER = {c: c + 32 for c in range(65, 91)}

TEMPLATES = {
    "apache-2.0": [
        "<<o>>this <<v:(project|work|software|file|code)>> is<</o>> <<v:(licensed|released)>> under the apache license "
        "<<o>>the license<</o>> version 2.0",
    ],
    "cc-by": [
        "<<o>>this work is<</o>> licensed under <<o>>a<</o>> cc by <<o>><<v:(nc|sa|nd):2>><</o>> <<v:[1-4]>> 0",
        "<<o>>this work is<</o>> licensed under <<o>>a<</o>> creative commons attribution <<o>><<v:[a-z]+:3>><</o>> "
        "<<v:[1-4]>> 0 <<o>><<v:(international|generic|unported)>><</o>> license",
    ],
    "gpl-2.0": ["<<o>>this work is<</o>> licensed under the gnu general public license version 2"],
    "gpl-3.0": ["<<o>>this work is<</o>> licensed under the gnu general public license version 3"],
    "gpl-notice": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version <<v:[23]>> of the license or "
        "<<o>>at your option<</o>> any later version",
    ],
    "mit-notice": [
        "released under the mit license",
        "<<o>>this <<v:(project|work|software|file|code)>> is<</o>> licensed under the mit license",
    ],
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice <<o>>including the next paragraph<</o>> shall be included in all "
        "copies or substantial portions of the software the software is provided as is without warranty of any kind "
        "express or implied including but not limited to the warranties of merchantability fitness for a particular "
        "purpose and noninfringement in no event shall the <<v:[a-z]+:6>> be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
        "software or the use or other dealings in the software",
    ],
    "isc-text": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the software "
        "is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct "
        "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether "
        "in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
    ],
    "bsd-text": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met <<o>>1<</o>> redistributions of source code must retain the above copyright "
        "notice this list of conditions and the following disclaimer <<o>>2<</o>> redistributions in binary form must "
        "reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution <<o>><<o>>3<</o>> neither the name of "
        "<<v:[^ ]+:8>> nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission<</o>> this software is provided by the <<v:[^ ]+:6>> as is "
        "and any express or implied warranties including but not limited to the implied warranties of merchantability "
        "and fitness for a particular purpose are disclaimed in no event shall the <<v:[^ ]+:6>> be liable for any "
        "direct indirect incidental special exemplary or consequential damages including but not limited to procurement "
        "of substitute goods or services loss of use data or profits or business interruption however caused and on any "
        "theory of liability whether in contract strict liability or tort including negligence or otherwise arising in "
        "any way out of the use of this software even if advised of the possibility of such damage",
    ],
    "apache-header": [
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required "
        "by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
        "basis without warranties or conditions of any kind either express or implied see the license for the specific "
        "language governing permissions and limitations under the license",
    ],
    "mpl-header": [
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at <<o>>http<</o>> <<o>>https<</o>> mozilla org mpl 2.0",
    ],
}

_MARK = re.compile(r"<<o>>|<</o>>|<<v:([^>]*?)(?::(\d+))?>>")


class Automaton:
    """Words move it; a step is a literal word or an expression, ``skips`` are moves without a word."""

    def __init__(self, template: str):
        self.literal: dict[int, dict[str, list[int]]] = defaultdict(dict)
        self.pattern: dict[int, list[tuple[re.Pattern, int]]] = defaultdict(list)
        self.skips: dict[int, list[int]] = defaultdict(list)
        self.mandatory = 0
        state, opened, last = 0, [], 0
        for m in [*_MARK.finditer(template), None]:
            for word in WORD.findall(template[last:m.start() if m else None].translate(LOWER)):
                self.literal[state].setdefault(word, []).append(state + 1)
                state += 1
                self.mandatory += not opened
            if m is None:
                break
            last = m.end()
            if m[0] == "<<o>>":
                opened.append(state)
            elif m[0] == "<</o>>":
                self.skips[opened.pop()].append(state)
            else:
                begin = state
                for i in range(int(m[2] or 1)):
                    self.pattern[state].append((re.compile(m[1]), state + 1))
                    state += 1
                    if i:
                        self.skips[begin + i].append(begin + int(m[2]))
        if opened or not self.mandatory:
            raise ValueError("a template needs mandatory words and closed regions")
        self.final = state

    def _closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def required(self) -> list[str]:
        """Literal words of every match: no skip passes over their step."""
        return [w for s, own in sorted(self.literal.items()) for w in own
                if not any(a <= s < b for a, ends in self.skips.items() for b in ends)]

    def first_words(self) -> tuple[set[str], bool]:
        """Literal words that can begin a match, and whether an expression can."""
        states = self._closed({0})
        return {w for s in states for w in self.literal.get(s, ())}, any(s in self.pattern for s in states)

    def match(self, words: list[str], start: int) -> int | None:
        """Where the longest accepted stretch from ``start`` ends (exclusive), or None."""
        states, at, found = self._closed({0}), start, None
        while True:
            if self.final in states:
                found = at
            if at == len(words):
                return found
            word = words[at]
            step = {t for s in states for t in self.literal.get(s, {}).get(word, ())}
            step |= {t for s in states for p, t in self.pattern.get(s, ()) if p.fullmatch(word)}
            if not step:
                return found
            states, at = self._closed(step), at + 1


class Scanner:
    """All templates; a text is searched only around a word that a template cannot do without."""

    def __init__(self, templates: dict[str, list[str]]):
        self.by_first: dict[str, list[tuple[str, Automaton]]] = defaultdict(list)
        self.anywhere: list[tuple[str, Automaton]] = []
        for label, texts in templates.items():
            for text in texts:
                a = Automaton(text)
                literal, free = a.first_words()
                if free:
                    self.anywhere.append((label, a))
                for w in () if free else literal:
                    self.by_first[w].append((label, a))
        # every template holds one of these words in its mandatory part, so a text without them has no match
        self.anchors = [max(Automaton(t).required(), key=lambda w: (w in _TELLING, len(w)))
                        for texts in templates.values() for t in texts]

    def spans(self, words: list[str], found: set[str]) -> list[tuple[str, int, int]]:
        if found.isdisjoint(self.anchors):
            return []
        out = []
        for w, entries in [*self.by_first.items(), *((None, [x]) for x in self.anywhere)]:
            if w is not None and w not in found:
                continue
            for at in range(len(words)) if w is None else places(words, w):
                for label, a in entries:
                    end = a.match(words, at)
                    if end is not None and end > at:
                        out.append((label, at, end))
        return out


# words that running prose hardly uses; only a choice of where to look first
_TELLING = ("apache", "creative", "cc", "gnu", "mit", "sublicense", "mozilla", "redistributions", "tortious")


def places(words: list[str], word: str) -> Iterator[int]:
    at = -1
    try:
        while True:
            at = words.index(word, at + 1)
            yield at
    except ValueError:
        return


def phrase_places(words: list[str], found: set[str]) -> list[tuple[int, str]]:
    out = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        if found.issuperset(parts):
            out += [(at, label) for at in places(words, parts[0]) if words[at:at + len(parts)] == parts]
    return out


RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, matches array<string>")


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """License labels of every whole text.

    Per row: the word count, the places of the base phrases (``first_word`` and ``last_word`` are null
    without one), base and all labels sorted and joined by commas (empty without any), ``matches`` as
    ``label:start:end`` in words, and the score: 1 if a template accepts, 0.5 for a phrase alone, else 0.
    A null or empty text has no words; a null id stays null; repeated rows are scanned each. Other columns
    are not read. The rows are scanned where they lie, one text at a time.
    """
    chosen = TEMPLATES if templates is None else templates

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for batch in batches:
            out = [[] for _ in range(9)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                words = WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower())
                found = set(words)
                base = phrase_places(words, found)
                spans = sorted(set(scanner.spans(words, found)), key=lambda s: (s[1], s[2], s[0]))
                at = [p for p, _ in base]
                base_labels = {b for _, b in base}
                row = (doc_id, len(words), len(base), min(at, default=None), max(at, default=None),
                       ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {s[0] for s in spans})),
                       1.0 if spans else 0.5 if base else 0.0, ["%s:%d:%d" % s for s in spans])
                for cells, value in zip(out, row):
                    cells.append(value)
            types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                             [f.split()[0] for f in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(batches_of, RESULT)
