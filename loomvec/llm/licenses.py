"""License scans by template markup.

A template is license wording with two kinds of markup: [[ ... ]] is an optional region and
{{name:a-b}} a replaceable region of a to b words. compile_template() turns it into an automaton
over words; a text is accepted where the mandatory words stand in order, exactly and without gaps
other than the optional and replaceable regions. The automaton runs only from places where a
template can begin, which a byte search for its least common mandatory word finds.

Beside it, the base phrases are looked up in every text; they hold whatever the templates say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_spans, narrow, pieces, read_table

#: The base phrases of the contract and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The wording of public licenses and of their standard notices, with what may be left out in [[ ]] and what
#: may be replaced in {{ }}. Words are compared after lower-casing A-Z; punctuation, bullets and line breaks aren't.
GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
BSD_1 = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
BSD_2 = "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_3 = "[[3]] neither the name of {{holder:1-12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_END = "this software is provided by {{holder:1-12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{holder:1-12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"


def notice(kind: str, version: str, later: bool) -> str:
    """The standard notice of a GNU license; `kind` stands before "general public license"."""
    end = f"either version {version} of the license or at your option any later version" if later else f"version {version} [[of the license]] only"
    return f"is free software you can redistribute it and or modify it under the terms of the gnu {kind} general public license as published by the free software foundation {end}"


TEMPLATES = {
    "mit": f"{GRANT} {WARRANTY}",
    "mit-grant": GRANT.split(" including without limitation")[0],
    "mit-release": "[[{{what:0-4}} is]] released under the [[terms of the]] mit license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-2-clause": f"{BSD_1} {BSD_2} {BSD_END}",
    "bsd-3-clause": f"{BSD_1} {BSD_2} {BSD_3} {BSD_END}",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "apache-2.0": "licensed under the apache license [[version]] 2 0 [[the license]]",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license [[you may obtain a copy of the license at {{address:1-8}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied]]",
    "gpl-2.0-or-later": notice("", "2", True),
    "gpl-3.0-or-later": notice("", "3", True),
    "gpl-2.0-only": notice("", "2", False),
    "gpl-3.0-only": notice("", "3", False),
    "lgpl-2.1-or-later": notice("lesser", "2 1", True),
    "lgpl-3.0-or-later": notice("lesser", "3", True),
    "agpl-3.0-or-later": notice("affero", "3", True),
    "gpl-3.0": "[[this]] {{work:0-3}} is licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 3 [[or later]]",
    "gpl-2.0": "[[this]] {{work:0-3}} is licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 2 [[or later]]",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[{{address:1-6}}]]",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license [[v]] 2 0",
    "bsl-1.0": "distributed under the boost software license version 1 0",
    "cc-by-nc-4.0": "licensed under [[a]] [[creative commons]] cc by nc 4 0 [[international]]",
    "cc-by-sa-4.0": "licensed under [[a]] [[creative commons]] cc by sa 4 0 [[international]]",
    "cc-by-4.0": "licensed under [[a]] [[creative commons]] cc by 4 0 [[international]]",
    "cc-by-4.0-notice": "licensed under [[a]] [[the]] creative commons attribution 4 0 international [[public]] [[license]]",
    "cc-by-sa-4.0-notice": "licensed under [[a]] [[the]] creative commons attribution sharealike 4 0 international [[public]] [[license]]",
    "cc0-1.0": "to the extent possible under law {{who:1-10}} waived all copyright and related or neighboring rights to",
    "all-rights-reserved": "copyright [[c]] {{year:1-2}} {{holder:0-6}} all rights reserved",
}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_W, _S = rb"[0-9a-z\x80-\xff]", rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_WORD = re.compile(_W + rb"+")
_PHRASES = [(re.compile(rb"(?<!" + _W + rb")" + _S.join(w.encode() for w in p.split()) + rb"(?!" + _W + rb")"), p.split()[-1].encode(), label) for p, label in PHRASES.items()]


@dataclass
class Automaton:
    """Word automaton without empty moves: `first` are the states at the start, step() moves them by a word."""

    label: str
    words: dict[int, dict[bytes, set[int]]] = field(default_factory=dict)  # state -> word -> states
    any_word: dict[int, set[int]] = field(default_factory=dict)  # state -> states after whatever word
    empty: dict[int, set[int]] = field(default_factory=dict)
    final: int = 0
    size: int = 1
    mandatory: list[bytes] = field(default_factory=list)
    before: int | None = 0  # most words in front of the first mandatory one

    def new(self) -> int:
        self.size += 1
        return self.size - 1

    def closed(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.empty.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def accepts_from(self, words: list[bytes], at: int) -> int:
        """The number of words of the longest accepted run from `at`; 0 if there is none."""
        states, best, i = self.closed({0}), 0, at
        while states and i < len(words):
            after: set[int] = set()
            for s in states:
                after |= self.words.get(s, {}).get(words[i], set()) | self.any_word.get(s, set())
            states = self.closed(after)
            i += 1
            if self.final in states:
                best = i - at
        return best


_MARKUP = re.compile(r"\[\[|\]\]|\{\{\w+:(\d+)-(\d+)\}\}|[^\s\[\]{}]+")


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of a template. Optional regions may nest and hold replaceable ones."""
    a = Automaton(label)
    here, open_at, in_front = 0, [], 0
    for m in _MARKUP.finditer(markup):
        token = m.group()
        if token == "[[":
            open_at.append(here)
        elif token == "]]":
            if not open_at:
                raise ValueError(f"{label}: an optional region ends that didn't begin")
            end = a.new()
            a.empty.setdefault(here, set()).add(end)
            a.empty.setdefault(open_at.pop(), set()).add(end)
            here = end
        elif m.group(1) is not None:
            low, high = int(m.group(1)), int(m.group(2))
            if low > high:
                raise ValueError(f"{label}: {token}")
            ends = [here] if low == 0 else []
            for i in range(high):
                after = a.new()
                a.any_word.setdefault(here, set()).add(after)
                here = after
                if i + 1 >= low:
                    ends.append(here)
            end = a.new()
            for e in ends:
                a.empty.setdefault(e, set()).add(end)
            here = end
            in_front += high if not a.mandatory else 0
        else:
            word = token.lower().encode()
            after = a.new()
            a.words.setdefault(here, {}).setdefault(word, set()).add(after)
            here = after
            if not open_at:
                a.mandatory.append(word)
            elif not a.mandatory:
                in_front += 1
    if open_at or not a.mandatory:
        raise ValueError(f"{label}: an open region, or no mandatory word")
    a.final, a.before = here, in_front
    return a


def find_templates(low: bytes, automata: list[Automaton], commonness: dict[bytes, int]) -> dict[str, int]:
    """label -> words of its longest accepted place in a lower-cased text."""
    out: dict[str, int] = {}
    words: list[bytes] | None = None
    places: dict[bytes, list[int]] = {}
    for a in automata:
        rare = min(a.mandatory, key=lambda w: commonness.get(w, -len(w)))
        if rare not in low or a.mandatory[0] not in low:
            continue
        if words is None:
            words = _WORD.findall(low)
            for i, w in enumerate(words):
                places.setdefault(w, []).append(i)
        if rare not in places:
            continue
        done, best = set(), 0
        for p in places.get(a.mandatory[0], ()):
            for start in range(max(0, p - a.before), p + 1):
                if start not in done:
                    done.add(start)
                    best = max(best, a.accepts_from(words, start))
        if best:
            out[a.label] = best
    return out


#: Words that many texts hold, and how common they are; templates are looked for by another of their words.
COMMON = {w: 1 for w in (b"the", b"of", b"is", b"and", b"to", b"in", b"a", b"this", b"under", b"work", b"2", b"0", b"3", b"4", b"by")}

DIGEST = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of docs with its words, base places and labels.

    score is 1 where a template is accepted, 0.5 where only a base phrase stands, else 0. Of several
    places of a template the longest counts, and equal ones are one label. Null and empty texts have no
    words and score 0; texts of any length are scanned whole, repeated rows each; an empty table gives an
    empty table; other columns of docs are ignored. Work on a text is linear in its length.
    """
    automata = [compile_template(k, v) for k, v in (TEMPLATES if templates is None else templates).items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_all, offsets = byte_spans(batch.column(1))
            for lo, hi in pieces(offsets, 4 << 20):
                at = offsets[lo : hi + 1] - offsets[lo]
                low = _LOWER[raw_all[offsets[lo] : offsets[hi]]]
                word = _IS_WORD[low]
                begins = word.copy()
                begins[1:] &= ~word[:-1]
                full = at[:-1][at[:-1] < at[1:]]
                begins[full] = word[full]
                starts = np.flatnonzero(begins)
                upto = np.searchsorted(starts, at)
                cols: list[list] = [[] for _ in range(6)]
                for i in range(hi - lo):
                    t = low[at[i] : at[i + 1]].tobytes()
                    found, labels = [], set()
                    for pattern, last, label in _PHRASES:
                        if last in t:
                            hits = [m.start() for m in pattern.finditer(t)]
                            if hits:
                                labels.add(label)
                                found += hits
                    own = find_templates(t, automata, COMMON)
                    index = np.searchsorted(starts, np.array(found, np.int64) + at[i]) - upto[i]
                    for c, v in zip(cols, (len(found), int(index.min()) if found else None, int(index.max()) if found else None, ",".join(sorted(labels)), ",".join(sorted(labels | set(own))), 1.0 if own else 0.5 if found else 0.0), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(upto).astype(np.int64)), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in DIGEST.split(", ")])

    return narrow(docs, doc_id=F.col(doc_id).cast("long"), text=text).mapInArrow(run, DIGEST)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
