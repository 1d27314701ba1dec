"""License scans by template matching.

A template is license wording with markup: ``<<...>>`` marks an optional region and ``{{...}}`` a replaceable one
(inside: the least and most words that may stand there).  Templates are compiled into token automata.  A template
accepts a stretch of text if its mandatory wording occurs exactly, word by word; optional regions may be missing and
replaceable ones may hold any words within their limits.  Besides, a fixed set of phrases is counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import LOWER, as_bytes, bound_batches, tidied

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# License wording.  {{0,12}} is a replaceable region of 0 to 12 words, <<...>> an optional one.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license <<,>> version 2.0",
    "gpl-2.0": "licensed under the <<terms of the>> gnu general public license <<,>> version 2",
    "gpl-3.0": "licensed under the <<terms of the>> gnu general public license <<,>> version 3",
    "gpl-2.0-or-later": "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or {{0,3}} any later version",
    "gpl-3.0-or-later": "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or {{0,3}} any later version",
    "cc-by-4.0": "licensed under <<a>> <<the>> <<creative commons attribution>> cc by <<license>> 4.0",
    "cc-by-nc-4.0": "licensed under <<a>> <<the>> cc by nc <<license>> 4.0",
    "cc-by-sa-4.0": "licensed under <<a>> <<the>> cc by sa <<license>> 4.0",
    "mit-notice": "released under the mit license",
    "mit-text": """<<the mit license>> <<mit license>> <<copyright {{0,20}}>> permission is hereby granted free of charge to any
        person obtaining a copy of this software and associated documentation files {{0,3}} to deal in {{1,2}} without
        restriction including without limitation the rights to use copy modify merge publish distribute sublicense and
        or sell copies of {{1,2}} and to permit persons to whom {{1,2}} is furnished to do so subject to the following
        conditions the above copyright notice and this permission notice <<including the next paragraph>> shall be
        included in all copies or substantial portions of {{1,2}}""",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met {{0,1}} redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer {{0,1}} redistributions in binary form must reproduce the
        above copyright notice this list of conditions and the following disclaimer in the documentation and or other
        materials provided with the distribution""",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit-full": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files {{0,3}} to deal in {{1,2}} without restriction including without limitation the rights to use
        copy modify merge publish distribute sublicense and or sell copies of {{1,2}} and to permit persons to whom {{1,2}}
        is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        <<including the next paragraph>> shall be included in all copies or substantial portions of {{1,2}}
        the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the {{2,6}}
        be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from
        out of or in connection with the software or the use or other dealings in the software""",
    "bsd-2-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met {{0,1}} redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer {{0,1}} redistributions in binary form must reproduce the
        above copyright notice this list of conditions and the following disclaimer in the documentation and or other
        materials provided with the distribution this software is provided by {{2,8}} as is and any express or implied
        warranties including but not limited to the implied warranties of merchantability and fitness for a particular
        purpose are disclaimed in no event shall {{2,8}} be liable for any direct indirect incidental special exemplary or
        consequential damages including but not limited to procurement of substitute goods or services loss of use data or
        profits or business interruption however caused and on any theory of liability whether in contract strict liability
        or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the
        possibility of such damage""",
    "bsd-3-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met {{0,1}} redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer {{0,1}} redistributions in binary form must reproduce the
        above copyright notice this list of conditions and the following disclaimer in the documentation and or other
        materials provided with the distribution {{0,1}} neither the name of {{1,10}} nor the names of {{1,4}} may be used
        to endorse or promote products derived from this software without specific prior written permission this software
        is provided by {{2,8}} as is and any express or implied warranties including but not limited to the implied
        warranties of merchantability and fitness for a particular purpose are disclaimed""",
    "isc-full": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies the software is
        provided as is and {{1,4}} disclaims all warranties with regard to this software including all implied warranties
        of merchantability and fitness in no event shall {{1,4}} be liable for any special direct indirect or consequential
        damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
        negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "apache-2.0-notice": """licensed under the apache license version 2.0 the license you may not use this file except in
        compliance with the license you may obtain a copy of the license at {{4,10}} unless required by applicable law or
        agreed to in writing software distributed under the license is distributed on an as is basis without warranties or
        conditions of any kind either express or implied see the license for the specific language governing permissions
        and limitations under the license""",
    "gpl-notice": """is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation either version {{1,1}} of the license or {{0,3}} any later
        version {{1,4}} is distributed in the hope that it will be useful but without any warranty without even the implied
        warranty of merchantability or fitness for a particular purpose see the gnu general public license for more
        details""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held
        liable for any damages arising from the use of this software permission is granted to anyone to use this software
        for any purpose including commercial applications and to alter it and redistribute it freely subject to the
        following restrictions""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish
        use compile sell or distribute this software either in source code form or as a compiled binary for any purpose
        commercial or non commercial and by any means""",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license <<,>> v 2.0",
}

#: Bytes of words: digits, a-z (after lower-casing) and all beyond ASCII.
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in LOWER)


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_WORD).split()


@dataclass
class Automaton:
    """States are places in the wording; ``step[s]`` maps a word to states, ``gap[s]`` are states any word leads to."""

    label: str
    step: list[dict[bytes, list[int]]]
    gap: list[list[int]]
    skip: list[list[int]]
    final: int
    must: list[bytes]
    first: frozenset[bytes] = frozenset()

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states


def compile_template(label: str, wording: str) -> Automaton:
    """The automaton of a template (optional regions may nest replaceable ones)."""
    step: list[dict[bytes, list[int]]] = [{}]
    gap: list[list[int]] = [[]]
    skip: list[list[int]] = [[]]
    must: list[bytes] = []
    opened: list[int] = []

    def new() -> int:
        step.append({})
        gap.append([])
        skip.append([])
        return len(step) - 1

    at = 0
    for part in re.findall(r"<<|>>|\{\{\d+,\d+\}\}|[^<>{}]+", " ".join(wording.split())):
        if part == "<<":
            opened.append(at)
        elif part == ">>":
            end = new()
            skip[at].append(end)
            skip[opened.pop()].append(end)
            at = end
        elif part.startswith("{{"):
            least, most = map(int, part[2:-2].split(","))
            places = [at]
            for _ in range(most):
                nxt = new()
                gap[places[-1]].append(nxt)
                places.append(nxt)
            at = new()
            for p in places[least:]:
                skip[p].append(at)
        else:
            for word in words_of(part.encode()):
                nxt = new()
                step[at].setdefault(word, []).append(nxt)
                at = nxt
                must += [word] * (not opened)
    a = Automaton(label, step, gap, skip, at, must)
    start = a.closure({0})
    if any(gap[s] for s in start) or a.final in start or not must:
        raise ValueError(f"{label}: a template has to begin with wording, and some of it has to be mandatory")
    a.first = frozenset(w for s in start for w in step[s])
    return a


def accepts(a: Automaton, words: list[bytes], at: int) -> int:
    """Where the longest stretch ends that begins at word ``at`` and that the template accepts; -1 if there is none."""
    states, best = a.closure({0}), -1
    for i in range(at, len(words)):
        states = a.closure({t for s in states for t in (*a.step[s].get(words[i], ()), *a.gap[s])})
        if not states:
            break
        if a.final in states:
            best = i + 1
    return best


class Scanner:
    """All phrases and templates."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases.items()]
        self.automata = [compile_template(label, t) for label, t in templates.items()]
        self.starts: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for w in a.first:
                self.starts.setdefault(w, []).append(a)
        # a text without any of these words can match nothing
        self.cue_of = {a.label: max(a.must, key=lambda w: (len(w), w)) for a in self.automata}
        cues = {max(p, key=len) for p, _ in self.phrases} | set(self.cue_of.values())
        self.cue = re.compile(b"|".join(sorted(map(re.escape, cues), key=len, reverse=True)))

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, str, bool]]]:
        """Number of words; what was found: first word, word after the last, label, whether a template says so."""
        low = text.translate(_WORD)
        words = low.split()
        if not self.cue.search(low):
            return len(words), []
        found = []
        have = set(words)
        for phrase, label in self.phrases:
            if have.issuperset(phrase):
                at = -1
                while (at := _index(words, phrase[0], at + 1)) >= 0:
                    if words[at : at + len(phrase)] == phrase:
                        found.append((at, at + len(phrase), label, False))
        for w in have & self.starts.keys():
            likely = [a for a in self.starts[w] if self.cue_of[a.label] in have]
            if likely:
                at = -1
                while (at := _index(words, w, at + 1)) >= 0:
                    for a in likely:
                        if (end := accepts(a, words, at)) >= 0:
                            found.append((at, end, a.label, True))
        return len(words), found


def _index(words: list[bytes], word: bytes, start: int) -> int:
    try:
        return words.index(word, start)
    except ValueError:
        return -1


def score_of(found: list[tuple[int, int, str, bool]], n_words: int) -> float:
    """0 without a finding; 0.5 for phrases alone; with a template from 0.75 up to 1, by how much of the text it is."""
    if not found:
        return 0.0
    full = [f for f in found if f[3]]
    return 0.75 + 0.25 * min(1.0, max(e - b for b, e, _, _ in full) / n_words) if full else 0.5


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, with_spans: bool = False) -> DataFrame:
    """Licenses that each whole text names or quotes; one row for each row, no shuffle.

    Returns ``id_col``, ``n_words``, ``n_base`` (places of phrases), ``first_word`` and ``last_word`` (smallest and
    largest start of a phrase, else null), ``base_labels``, ``labels`` (with those of templates; both sorted, distinct,
    comma-joined), ``score`` (see :func:`score_of`) and, if asked for, ``spans`` (array of begin, end, label).

    A null text is an empty one: no words, no labels, score 0.  Repeated rows are scanned each; a null id stays null;
    other columns are ignored; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    scanner_of = (phrases or PHRASES, templates if templates is not None else TEMPLATES)
    id_type = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*scanner_of)
        for batch in batches:
            rows = [scanner.scan(t) for t in as_bytes(batch.column(1))]
            base = [[f for f in found if not f[3]] for _, found in rows]
            joined = lambda found: ",".join(sorted({f[2] for f in found}))
            columns = {
                id_col: batch.column(0),
                "n_words": pa.array([n for n, _ in rows], pa.int64()),
                "n_base": pa.array([len(b) for b in base], pa.int64()),
                "first_word": pa.array([min((f[0] for f in b), default=None) for b in base], pa.int64()),
                "last_word": pa.array([max((f[0] for f in b), default=None) for b in base], pa.int64()),
                "base_labels": pa.array([joined(b) for b in base], pa.string()),
                "labels": pa.array([joined(found) for _, found in rows], pa.string()),
                "score": pa.array([score_of(found, n) for n, found in rows], pa.float64()),
            }
            if with_spans:
                columns["spans"] = pa.array([[{"begin": b, "end": e, "label": label} for b, e, label, _ in found] for _, found in rows], span)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"`{id_col}` {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double" + ", spans array<struct<begin:bigint,end:bigint,label:string>>" * with_spans
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(tidied(run), schema)
