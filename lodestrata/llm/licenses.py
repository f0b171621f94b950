"""License scans: templates with optional and replaceable regions, matched by token automata.

A template's markup: plain words are mandatory; `[[ ... ]]` is an optional region and may nest; `{{n}}` is a
replaceable region of at most n words of any kind. All templates compile into one nondeterministic automaton
over words, run as a deterministic one whose states are made when a text first needs them. A text is accepted
where a stretch of its words has the mandatory wording exactly, whatever fills the regions.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import ASCII_LOWER, row_map

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# The phrases of the base scan and their labels.
PHRASES = {
    ("mit", "license"): "mit",
    ("apache", "license"): "apache",
    ("general", "public", "license"): "gpl",
}

# Public licenses, and the names that notices call them by.
NAMES = {
    "0bsd": ["0bsd license", "zero clause bsd license", "bsd zero clause license"],
    "agpl-3.0": ["[[gnu]] affero general public license [[version]] 3", "[[gnu]] agpl 3", "[[gnu]] agpl 3.0", "[[gnu]] agplv3"],
    "apache-2.0": ["apache license [[version]] 2.0", "apache license v2.0", "apache 2.0 [[license]]", "asl 2.0"],
    "artistic-2.0": ["artistic license 2.0"],
    "bsd-2-clause": ["bsd 2 clause [[simplified]] license", "2 clause bsd license", "simplified bsd license", "freebsd license"],
    "bsd-3-clause": ["bsd 3 clause [[new or revised]] license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license"],
    "bsl-1.0": ["boost software license [[version]] 1.0"],
    "cc-by-4.0": ["creative commons attribution 4.0 [[international]] [[public]] license", "cc by 4.0 [[international]] [[license]]"],
    "cc-by-nc-4.0": ["creative commons attribution {{1}} noncommercial 4.0 [[international]] [[public]] license", "creative commons attribution non commercial 4.0 [[international]] [[public]] license", "cc by nc 4.0 [[international]] [[license]]"],
    "cc-by-nc-sa-4.0": ["creative commons attribution noncommercial sharealike 4.0 [[international]] [[public]] license", "cc by nc sa 4.0 [[international]] [[license]]"],
    "cc-by-nd-4.0": ["creative commons attribution noderivatives 4.0 [[international]] [[public]] license", "cc by nd 4.0 [[international]] [[license]]"],
    "cc-by-sa-3.0": ["creative commons attribution sharealike [[license]] 3.0 [[unported]] [[license]]", "cc by sa 3.0 [[unported]] [[license]]"],
    "cc-by-sa-4.0": ["creative commons attribution sharealike 4.0 [[international]] [[public]] license", "cc by sa 4.0 [[international]] [[license]]"],
    "cc0-1.0": ["cc0 1.0 [[universal]]", "creative commons zero 1.0 [[universal]]", "creative commons cc0 [[1.0]] [[universal]]"],
    "epl-2.0": ["eclipse public license [[version]] 2.0", "eclipse public license v2.0", "epl 2.0"],
    "gfdl-1.3": ["gnu free documentation license [[version]] 1.3"],
    "gpl-2.0": ["[[gnu]] general public license [[as published by the free software foundation]] [[either]] version 2 [[or any later version]]", "[[gnu]] gpl 2.0", "[[gnu]] gpl v2", "[[gnu]] gplv2"],
    "gpl-3.0": ["[[gnu]] general public license [[as published by the free software foundation]] [[either]] version 3 [[or any later version]]", "[[gnu]] gpl 3.0", "[[gnu]] gpl v3", "[[gnu]] gplv3"],
    "isc": ["isc license"],
    "lgpl-2.1": ["[[gnu]] lesser general public license [[as published by the free software foundation]] [[either]] version 2.1 [[or any later version]]", "[[gnu]] lgpl 2.1", "[[gnu]] lgplv2.1"],
    "lgpl-3.0": ["[[gnu]] lesser general public license [[as published by the free software foundation]] [[either]] version 3 [[or any later version]]", "[[gnu]] lgpl 3.0", "[[gnu]] lgplv3"],
    "mit": ["mit license", "expat license"],
    "mpl-2.0": ["mozilla public license [[version]] [[v.]] 2.0", "mpl 2.0"],
    "ofl-1.1": ["sil open font license [[version]] 1.1", "ofl 1.1"],
    "unlicense": ["unlicense"],
    "wtfpl": ["do what the fuck you want to public license", "wtfpl"],
    "zlib": ["zlib license", "zlib libpng license"],
}

#: What stands before a name in a notice.
NOTICE = "under [[the terms [[and conditions]] of]] [[the]] [[a]] [[version 2.0 of the]] "

# Identifiers in machine-readable tags of source files.
TAGS = [*NAMES, "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later", "lgpl-2.1-or-later", "lgpl-3.0-or-later", "agpl-3.0-or-later"]

# Wordings of public licenses and notices, with markup.
_AS_IS = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
    merchantability fitness for a particular purpose and noninfringement in no event shall the authors [[or copyright holders]] be liable for any claim
    damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or
    other dealings in the software"""
_BSD_GRANT = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
    are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
    [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
    documentation and or other materials provided with the distribution"""
_BSD_NAMES = """[[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software
    without specific prior written permission"""
_BSD_AS_IS = """this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties of
    merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct indirect incidental special
    exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business
    interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in
    any way out of the use of this software even if advised of the possibility of such damage"""
_ISC_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = "provided that the above copyright notice and this permission notice appear in all copies"
_ISC_AS_IS = """the software is provided as is and {{6}} disclaims all warranties with regard to this software including all implied warranties of
    merchantability and fitness in no event shall {{6}} be liable for any special direct indirect or consequential damages or any damages whatsoever
    resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with
    the use or performance of this software"""
_MIT_GRANT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
    [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge publish
    distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the
    following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all
    copies or substantial portions of the software"""
_FSF_OFFER = "is free software you can redistribute it and or modify it under the terms of the gnu"
_FSF_VERSION = "as published by the free software foundation either version"

FULL = [
    ("apache-2.0", """licensed under the apache license version 2.0 [[the license]] you may not use this file except in compliance with the
        license you may obtain a copy of the license at {{12}} unless required by applicable law or agreed to in writing software distributed
        under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"""),
    ("mit", _MIT_GRANT),
    ("mit", f"{_MIT_GRANT} {_AS_IS}"),
    ("mit-0", f"{_MIT_GRANT.split(' subject to the')[0]} {_AS_IS}"),
    ("bsd-2-clause", _BSD_GRANT),
    ("bsd-2-clause", f"{_BSD_GRANT} {_BSD_AS_IS}"),
    ("bsd-3-clause", f"{_BSD_GRANT} {_BSD_NAMES}"),
    ("bsd-3-clause", f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_AS_IS}"),
    ("isc", f"{_ISC_GRANT} {_ISC_NOTICE}"),
    ("isc", f"{_ISC_GRANT} {_ISC_NOTICE} {_ISC_AS_IS}"),
    ("0bsd", f"{_ISC_GRANT} {_ISC_AS_IS}"),
    ("gpl-2.0", f"{_FSF_OFFER} general public license {_FSF_VERSION} 2"),
    ("gpl-3.0", f"{_FSF_OFFER} general public license {_FSF_VERSION} 3"),
    ("lgpl-2.1", f"{_FSF_OFFER} lesser general public license {_FSF_VERSION} 2.1"),
    ("lgpl-3.0", f"{_FSF_OFFER} lesser general public license {_FSF_VERSION} 3"),
    ("agpl-3.0", f"{_FSF_OFFER} affero general public license {_FSF_VERSION} 3"),
    ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license v. 2.0 if a copy of the mpl was not distributed with this
        file you can obtain one at"""),
    ("epl-2.0", """this program and the accompanying materials are made available under the terms of the eclipse public license {{3}} 2.0 which is available at"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute
        this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising
        from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it
        and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you
        wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not
        required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may
        not be removed or altered from any source distribution"""),
    ("bsl-1.0", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license [[the software]] to use reproduce display distribute execute and transmit the software"""),
    ("wtfpl", """everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the
        name is changed do what the fuck you want to public license"""),
    ("cc0-1.0", """to the extent possible under law {{12}} has waived all copyright and related or neighboring rights to"""),
]

#: Licenses whose terms stand in license_texts, as their publishers have them: from the first clause or preamble to the last, all mandatory.
WHOLE = ["apache-2.0", "artistic-1.0-perl", "cc0-1.0", "gfdl-1.3", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "mpl-2.0"]


def whole_text(label: str) -> str:
    """The terms of a license as a template without regions."""
    text = pkgutil.get_data(__package__, f"license_texts/{label}.txt").decode()
    return re.sub(r"[\[\]{}]", " ", text)


#: All templates: names in notices, tags, wordings of short licenses and of notices, and whole licenses.
TEMPLATES = [(label, NOTICE + name) for label, names in NAMES.items() for name in names]
TEMPLATES += [(tag, f"spdx license identifier {tag}") for tag in TAGS]
TEMPLATES += FULL
TEMPLATES += [(label, whole_text(label)) for label in WHOLE]


class TokenAutomaton:
    """Finds every template in a list of words, in one pass from left to right."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.words: list[dict[str, list[int]]] = []  # of a state: word to next states
        self.wild: list[list[int]] = []
        self.free: list[list[int]] = []
        self.share: list[float] = []
        self.label: list[str | None] = []
        starts = []
        for label, markup in templates:
            parts = [(m[1] or m[2] or "") if not (m[3] or m[4]) else ("?" + m[3] if m[3] else m[4]) for m in re.finditer(r"(\[\[)|(\]\])|\{\{(\d+)\}\}|([^\s\[\]{}]+)", markup)]
            tokens = [x for p in parts for x in ([p] if p in ("[[", "]]") or p[:1] == "?" else LICENSE_WORD.findall(p.translate(ASCII_LOWER)))]
            depth = total = 0
            for t in tokens:
                depth += (t == "[[") - (t == "]]")
                total += not depth and t not in ("[[", "]]") and t[:1] != "?"
            if depth or not total:
                raise ValueError(f"template {label}: unbalanced regions or no mandatory word")
            at, done, open_at = self._state(0.0), 0, []
            starts.append(at)
            for t in tokens:
                if t == "[[":
                    open_at.append(at)
                    at = self._linked(at, done / total)
                elif t == "]]":
                    end = self._linked(at, done / total)
                    self.free[open_at.pop()].append(end)
                    at = end
                elif t[:1] == "?":
                    exits = [at]
                    for _ in range(int(t[1:])):
                        nxt = self._state(done / total)
                        self.wild[at].append(nxt)
                        exits.append(at := nxt)
                    at = self._state(done / total)
                    for x in exits:
                        self.free[x].append(at)
                else:
                    done += not open_at
                    nxt = self._state(done / total)
                    self.words[at].setdefault(t, []).append(nxt)
                    at = nxt
            self.label[at] = label
        self.start = self._closed(starts)
        self.first = frozenset(w for s in self.start for w in self.words[s])
        self.known = frozenset(w for x in self.words for w in x)
        self.steps: dict[tuple[frozenset, str | None], tuple[frozenset, float, tuple]] = {}

    def _state(self, share: float) -> int:
        for table, empty in ((self.words, {}), (self.wild, []), (self.free, []), (self.share, share), (self.label, None)):
            table.append(type(empty)(empty) if isinstance(empty, (dict, list)) else empty)
        return len(self.words) - 1

    def _linked(self, at: int, share: float) -> int:
        nxt = self._state(share)
        self.free[at].append(nxt)
        return nxt

    def _closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def _step(self, state: frozenset, word: str | None) -> tuple[frozenset, float, tuple]:
        nxt = [y for s in state for y in (*self.words[s].get(word, ()), *self.wild[s])]
        out = self._closed(nxt) | self.start
        found = (out, max((self.share[s] for s in out), default=0.0), tuple(sorted({self.label[s] for s in out if self.label[s]})))
        if len(self.steps) > 100_000:  # texts of a kind that needs ever new states
            self.steps.clear()
        self.steps[state, word] = found
        return found

    def scan(self, words: list[str]) -> tuple[set[str], float]:
        """Labels of the templates found, and the largest share of a template's mandatory words that was matched in place."""
        labels: set[str] = set()
        best, state = 0.0, self.start
        if self.first.isdisjoint(words):
            return labels, best
        known, steps, start, first = self.known, self.steps, self.start, self.first
        for w in words:
            if state is start and w not in first:
                continue
            w = w if w in known else None
            state, share, found = steps.get((state, w)) or self._step(state, w)
            if len(state) == len(start):
                state = start
            best = max(best, share)
            labels.update(found)
        return labels, best


def base_places(words: list[str]) -> tuple[list[int], set[str]]:
    """Starts of all places of PHRASES, and their labels."""
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        n, last, at = len(phrase), phrase[-1], -1
        try:
            while True:
                at = words.index(last, at + 1)
                if at >= n - 1 and tuple(words[at - n + 1 : at + 1]) == phrase:
                    starts.append(at - n + 1)
                    labels.add(label)
        except ValueError:
            pass
    return starts, labels


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each row of df: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are those of the whole text with A-Z lower-cased. score: 1 where a template is accepted, else the
    largest share of its mandatory words that stood in place. Null texts are empty: no words, nulls for the
    places, empty labels, score 0. Ids may be null or repeat; other columns are not read.
    """
    chosen = TEMPLATES if templates is None else templates

    def make():
        automaton = TokenAutomaton(chosen)

        def one(text: str | None) -> tuple:
            text = text or ""
            words = LICENSE_WORD.findall(text.lower() if text.isascii() else text.translate(ASCII_LOWER))
            starts, base = base_places(words)
            found, score = automaton.scan(words)
            return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), round(score, 6)

        return one

    shape = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return row_map(df, [F.col(id_col)], F.col(text_col), make, shape)
