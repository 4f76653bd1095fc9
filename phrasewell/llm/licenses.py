"""License scans by template-markup matching (operator 2).

A template is wording with ``[[optional]]`` regions, nestable, and
``{{name:low-high}}`` regions that any low to high words may replace.  It
compiles to a token automaton; a text is accepted where the automaton reaches its end,
that is, where all mandatory wording stands exactly and in order.  Words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, so punctuation never matters.

Templates of licenses are whole texts, conditions included, so a neighbour that
differs by a clause is not accepted; templates of notices are the sentences that name a license.
Of matches of which one lies inside another the outer one counts, and a notice right
after a word of ``DENIALS`` does not.

Whole texts, however long, are scanned in one pass, no shuffle.  Automata start only at words that
can begin a template, and texts without the longest of any template's first ``OPENING`` mandatory
words are settled by one search.

Null text counts as empty: no words, no labels, score 0.  Rows are
independent, so ties, repeats and empty tables need no care.  Existing columns of the result's name are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Public wording of common licenses and notices.
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall {{holders:1-20}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_START = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_1 = "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_2 = "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_3 = "[[3]] neither the name of {{holder:1-20}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = (
    "this software is provided by {{holders:1-20}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {{owner:1-20}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ISC_START = "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    "the software is provided as is and {{author:1-12}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall {{owner:1-12}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_GNU = "[[as published by the free software foundation]] [[either]] version {0} [[of the license]] [[or [[at your option]] any later version]]"
_BY = ("licensed", "released", "distributed", "available")
TEMPLATES = (
    *(("mit", f"{by} under the [[terms of the]] mit license") for by in _BY),
    ("mit", _MIT_GRANT),
    ("x11", f"{_MIT_GRANT} except as contained in this notice the name of {{{{holder:1-20}}}} shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from {{{{owner:1-20}}}}"),
    ("apache-2", "licensed under the [[terms of the]] apache license version 2 0 [[the license]]"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at [[http www apache org licenses license 2 0]] [[https www apache org licenses license 2 0]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-2", "under the [[terms of the]] gnu general public license " + _GNU.format(2)),
    ("gpl-3", "under the [[terms of the]] gnu general public license " + _GNU.format(3)),
    ("lgpl-3", "under the [[terms of the]] gnu lesser general public license " + _GNU.format(3)),
    ("agpl-3", "under the [[terms of the]] gnu affero general public license " + _GNU.format(3)),
    ("bsd-2", f"{_BSD_START} {_BSD_1} {_BSD_2} {_BSD_END}"),
    ("bsd-3", f"{_BSD_START} {_BSD_1} {_BSD_2} {_BSD_3} {_BSD_END}"),
    ("cc-by-nc-4", "licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0 [[international]] [[license]]"),
    ("cc-by-4", "licensed under [[a]] [[the]] [[creative commons]] cc by 4 0 [[international]] [[license]]"),
    ("cc-by-sa-4", "licensed under [[a]] [[the]] [[creative commons]] cc by sa 4 0 [[international]] [[license]]"),
    ("cc-by-nc-4", "licensed under [[a]] [[the]] creative commons attribution noncommercial 4 0 international [[public]] license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http mozilla org mpl 2 0]] [[https mozilla org mpl 2 0]]"),
    ("isc", f"{_ISC_START} provided that the above copyright notice and this permission notice appear in all copies {_ISC_END}"),
    ("0bsd", f"{_ISC_START} {_ISC_END}"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)
# A notice after one of these denies its license (up to two words between, as in "not being").
DENIALS = frozenset(b"not never nor no longer neither without".split())

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Mandatory words of a template of which one must stand in a text for it to be scanned.
OPENING = 8
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Automaton:
    """Token automaton of one template.  ``moves[s]``: (word or None for any, next); ``skips[s]``: free moves; ``worth[s]``: mandatory words behind s."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.moves: list[list[tuple[bytes | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.worth = [0]
        self.mandatory: list[bytes] = []
        at, open_ = 0, []
        for part in re.findall(r"\[\[|\]\]|\{\{\w+:\d+-\d+\}\}|[^\s\[\]{}]+", markup):
            if part == "[[":
                open_.append(at)
            elif part == "]]":
                end = self.state(at)
                self.skips[at].append(end)
                self.skips[open_.pop()].append(end)
                at = end
            elif part.startswith("{{"):
                low, high = map(int, part[2:-2].split(":")[1].split("-"))
                end = self.state(at)
                for n in range(high + 1):
                    if n >= low:
                        self.skips[at].append(end)
                    if n < high:
                        to = self.state(at)
                        self.moves[at].append((None, to))
                        at = to
                at = end
            else:
                word = part.encode()
                to = self.state(at)
                if not open_:
                    self.mandatory.append(word)
                    self.worth[to] += 1
                self.moves[at].append((word, to))
                at = to
        if open_:
            raise ValueError("unclosed optional region")
        if not self.mandatory:
            raise ValueError("a template needs mandatory wording")
        self.end = at
        self.first = frozenset(self.closure({0}))
        #: Moves by state set and word, found as they are needed; bounded by the template.
        self.known: dict[tuple[frozenset, bytes | None], frozenset] = {}
        self.words = {w for m in self.moves for w, _ in m if w is not None}

    def state(self, before: int) -> int:
        self.moves.append([])
        self.skips.append([])
        self.worth.append(self.worth[before])
        return len(self.moves) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for to in self.skips[todo.pop()]:
                if to not in out:
                    out.add(to)
                    todo.append(to)
        return out

    def starts(self) -> set[bytes | None]:
        return {w for s in self.first for w, _ in self.moves[s]}

    def run(self, words: Sequence[bytes], at: int) -> tuple[int | None, int]:
        """End of the longest accepted stretch from ``at`` (None: not accepted), and the mandatory words reached."""
        states, best, reached = self.first, None, 0
        for i in range(at, len(words)):
            w = words[i] if words[i] in self.words else None
            if (to := self.known.get((states, w))) is None:
                to = self.known[states, w] = frozenset(self.closure({t for s in states for x, t in self.moves[s] if x is None or x == w}))
            states = to
            if not states:
                break
            reached = max(reached, *(self.worth[s] for s in states))
            if self.end in states:
                best = i + 1
        return best, reached


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES):
        self.phrases = [(p.encode().split(), label) for p, label in phrases]
        # A template that starts with a replaceable word is entered at its first fixed word, so that starts stay few.
        self.automata = [Automaton(label, markup) for label, markup in templates]
        self.by_start: dict[bytes, list[tuple[int, int]]] = {}
        for k, a in enumerate(self.automata):
            depth, states = 0, a.first
            while None in {w for s in states for w, _ in a.moves[s]}:
                states = a.closure({to for s in states for _, to in a.moves[s]})
                depth += 1
            for w in {w for s in states for w, _ in a.moves[s]}:
                self.by_start.setdefault(w, []).append((k, depth))
        longest = {max(a.mandatory[:OPENING], key=len) for a in self.automata} | {max(p, key=len) for p, _ in self.phrases}
        self.anchor = re.compile(b"|".join(sorted(map(re.escape, longest))))

    def __call__(self, text: str | None) -> dict:
        data = (text or "").encode().lower()
        marks = _IN_WORD[np.frombuffer(data, np.uint8)]
        n_words = int(np.count_nonzero(marks[1:] & ~marks[:-1]) + (marks.size > 0 and bool(marks[0])))
        out = {"n_words": n_words, "places": [], "matches": [], "score": 0.0}
        if not self.anchor.search(data):
            return out
        words = WORD.findall(data)
        where: dict[bytes, list[int]] = {}
        wanted = {p[0] for p, _ in self.phrases} | set(self.by_start)
        for i, w in enumerate(words):
            if w in wanted:
                where.setdefault(w, []).append(i)
        for p, label in self.phrases:
            out["places"] += [{"label": label, "start": i} for i in where.get(p[0], ()) if words[i : i + len(p)] == p]
        for w, spots in where.items():
            for k, depth in self.by_start.get(w, ()):
                a = self.automata[k]
                for i in spots:
                    if i >= depth:
                        end, reached = a.run(words, i - depth)
                        if not DENIALS.isdisjoint(words[max(0, i - depth - 2) : i - depth]):
                            continue
                        out["score"] = max(out["score"], min(1.0, reached / len(a.mandatory)))
                        if end is not None:
                            out["matches"].append({"label": a.label, "start": i - depth, "end": end})
        out["places"].sort(key=lambda x: (x["start"], x["label"]))
        outer, reach = [], -1
        for m in sorted(out["matches"], key=lambda x: (x["start"], -x["end"], x["label"])):
            # Matches of the same stretch stay together; what lies inside an earlier one goes.
            if m["end"] > reach or (outer and (m["start"], m["end"]) == (outer[-1]["start"], outer[-1]["end"])):
                outer.append(m)
                reach = max(reach, m["end"])
        out["matches"] = outer
        if out["places"] or out["matches"]:
            out["score"] = 1.0
        return out


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType())]))),
    T.StructField("matches", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("score", T.DoubleType()),
])


def scan_licenses(docs: DataFrame, text: str = "text", as_: str = "license", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """``docs`` with the struct ``as_``: ``n_words``, base ``places``, template ``matches`` (word positions) and ``score``."""
    docs = docs.drop(*({as_} & set(docs.columns)))
    kind = pa.struct([("n_words", pa.int64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))), ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for b in batches:
            found = [scanner(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, as_])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(as_, RESULT)]))
