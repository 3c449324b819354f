"""License scans by template-markup matching (operator 6).

A template is a license text or notice in which ``<<opt>> ... <<end>>`` encloses words that may
be left out and ``<<any:n>>`` stands for up to n words of the user's own (names, years).  Each
template is compiled into an automaton over words; a text has the license if the automaton
accepts a run of its words, that is, if all mandatory wording stands there exactly and in
order.  Words are runs of ASCII letters and digits and non-ASCII characters, lower-cased
(A-Z), so punctuation, line breaks and comment marks never matter.

Short licenses (MIT, ISC, 0BSD, BSD, zlib, Boost, Unlicense) are templates from the grant to the
end of the disclaimer: one word changed or left out late in the text and it is not accepted.
Long ones (Apache, GPL, LGPL, AGPL, MPL) are templates of their standard notice and of the head
of the license file, and of the sentence that refers to them; the body of such a file is not
compared word by word.

Beside the templates three fixed phrases are counted wherever their words stand in a row.

Texts are read in place, one at a time.  A text without a trigger word of any template is
only counted.

Defined results: a null or empty text has no words, no labels and score 0; every row is
scanned on its own; an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weekcast.llm.common import ALNUM_BYTES, arrow_rows, byte_texts, private

#: Fixed phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_MIT_GRANT = """permission is hereby granted free of charge to any person obtaining a copy of this
software and associated documentation files the software to deal in the software without
restriction including without limitation the rights to use copy modify merge publish distribute
sublicense and or sell copies of the software and to permit persons to whom the software is
furnished to do so subject to the following conditions the above copyright notice and this
permission notice <<opt>>including the next paragraph<<end>> shall be included in all copies or
substantial portions of the software"""
_AS_IS = """the software is provided as is without warranty of any kind express or implied including but
not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
in no event shall <<any:12>> be liable for any claim damages or other liability whether in an action of
contract tort or otherwise arising from out of or in connection with the software or the use or other
dealings in the software"""
_BSD_HEAD = """redistribution and use in source and binary forms with or without modification are
permitted provided that the following conditions are met <<opt>>1<<end>> redistributions of source code
must retain the above copyright notice this list of conditions and the following disclaimer
<<opt>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of
conditions and the following disclaimer in the documentation and or other materials provided with
the distribution"""
_BSD_NAMES = """<<opt>>3<<end>> neither the name of <<any:12>> nor the names of <<opt>>its<<end>> <<any:3>>
contributors may be used to endorse or promote products derived from this software without specific
prior written permission"""
_BSD_AS_IS = """this software is provided by <<any:12>> as is and any express or implied warranties including but
not limited to the implied warranties of merchantability and fitness for a particular purpose are
disclaimed in no event shall <<any:12>> be liable for any direct indirect incidental special exemplary
or consequential damages including but not limited to procurement of substitute goods or services loss
of use data or profits or business interruption however caused and on any theory of liability whether
in contract strict liability or tort including negligence or otherwise arising in any way out of the
use of this software even if advised of the possibility of such damage"""
_ISC_GRANT = """permission to use copy modify and <<opt>>or<<end>> distribute this software for any purpose with
or without fee is hereby granted"""
_ISC_AS_IS = """the software is provided as is and <<any:6>> disclaims all warranties with regard to this software
including all implied warranties of merchantability and fitness in no event shall <<any:6>> be liable for
any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use
data or profits whether in an action of contract negligence or other tortious action arising out of or in
connection with the use or performance of this software"""
_GNU = """this <<any:1>> is free software you can redistribute it and or modify it under the terms of the gnu
{} general public license as published by the free software foundation either version <<any:2>> of the
license or at your option any later version <<opt>>this <<any:1>> is distributed in the hope that it will
be useful but without any warranty without even the implied warranty of merchantability or fitness for a
particular purpose see the gnu {} general public license for more details<<end>>"""
_FSF = """<<any:4>> copyright c <<any:4>> free software foundation inc <<any:12>> everyone is permitted to copy and
distribute verbatim copies of this license document but changing it is not allowed"""

#: Templates by label; a label may have several.
TEMPLATES = (
    ("mit", f"{_MIT_GRANT} {_AS_IS}"),
    ("mit", "<<opt>>is<<end>> released under the <<opt>>terms of the<<end>> mit license"),
    ("mit", "licensed under the <<opt>>terms of the<<end>> mit license"),
    ("bsd-3-clause", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_AS_IS}"),
    ("bsd-2-clause", f"{_BSD_HEAD} {_BSD_AS_IS}"),
    ("isc", f"""{_ISC_GRANT} provided that the above copyright notice and this permission notice appear in all
     copies {_ISC_AS_IS}"""),
    ("0bsd", f"{_ISC_GRANT} {_ISC_AS_IS}"),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will
     <<any:8>> be held liable for any damages arising from the use of this software permission is granted to
     anyone to use this software for any purpose including commercial applications and to alter it and
     redistribute it freely subject to the following restrictions <<opt>>1<<end>> the origin of this software
     must not be misrepresented you must not claim that you wrote the original software if you use this
     software in a product an acknowledgment in the product documentation would be appreciated but is not
     required <<opt>>2<<end>> altered source versions must be plainly marked as such and must not be
     misrepresented as being the original software <<opt>>3<<end>> this notice may not be removed or altered
     from any source distribution"""),
    ("bsl-1.0", """permission is hereby granted free of charge to any person or organization obtaining a copy of
     the software and accompanying documentation covered by this license the software to use reproduce display
     distribute execute and transmit the software and to prepare derivative works of the software and to permit
     third parties to whom the software is furnished to do so all subject to the following the copyright notices
     in the software and this entire statement including the above license grant this restriction and the
     following disclaimer must be included in all copies of the software in whole or in part and all derivative
     works of the software unless such copies or derivative works are solely in the form of machine executable
     object code generated by a source language processor the software is provided as is without warranty of any
     kind express or implied including but not limited to the warranties of merchantability fitness for a
     particular purpose title and non infringement in no event shall the copyright holders or anyone distributing
     the software be liable for any damages or other liability whether in contract tort or otherwise arising from
     out of or in connection with the software or the use or other dealings in the software"""),
    ("unlicense", f"""this is free and unencumbered software released into the public domain anyone is free to copy
     modify publish use compile sell or distribute this software either in source code form or as a compiled
     binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize
     copyright laws the author or authors of this software dedicate any and all copyright interest in the software
     to the public domain we make this dedication for the benefit of the public at large and to the detriment of
     our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all
     present and future rights to this software under copyright law {_AS_IS}"""),
    ("apache-2.0", """licensed under the apache license version 2 0 <<opt>>the license you may not use this
     file except in compliance with the license<<end>>"""),
    ("apache-2.0", """apache license version 2 0 january 2004 <<any:6>> terms and conditions for use reproduction
     and distribution <<opt>>1<<end>> definitions license shall mean the terms and conditions for use reproduction
     and distribution as defined by sections 1 through 9 of this document"""),
    ("gpl-2.0", """licensed under the <<opt>>terms of the<<end>> gnu general public license <<opt>>gpl<<end>>
     version 2 <<opt>>or <<opt>>at your option<<end>> any later version<<end>>"""),
    ("gpl-2.0", f"gnu general public license version 2 june 1991 {_FSF}"),
    ("gpl-3.0", """licensed under the <<opt>>terms of the<<end>> gnu general public license <<opt>>gpl<<end>>
     version 3 <<opt>>or <<opt>>at your option<<end>> any later version<<end>>"""),
    ("gpl-3.0", f"gnu general public license version 3 29 june 2007 {_FSF}"),
    ("lgpl-3.0", f"gnu lesser general public license version 3 29 june 2007 {_FSF}"),
    ("agpl-3.0", f"gnu affero general public license version 3 19 november 2007 {_FSF}"),
    ("gpl", _GNU.format("", "")),
    ("lgpl", _GNU.format("lesser", "lesser")),
    ("agpl", _GNU.format("affero", "affero")),
    ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license
     <<opt>>v<<end>> 2 0"""),
    ("mpl-2.0", """mozilla public license version 2 0 <<any:3>> definitions <<any:2>> contributor means each
     individual or legal entity that creates contributes to the creation of or owns covered software"""),
    ("cc-by-4.0", "licensed under <<opt>>a<<end>> <<opt>>the<<end>> cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under <<opt>>a<<end>> <<opt>>the<<end>> cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under <<opt>>a<<end>> <<opt>>the<<end>> cc by nc 4 0"),
    ("cc-by-4.0", """licensed under <<opt>>a<<end>> <<opt>>the<<end>> creative commons attribution 4 0
     international <<opt>>license<<end>>"""),
    ("cc-by-nc-4.0", """licensed under <<opt>>a<<end>> <<opt>>the<<end>> creative commons attribution
     noncommercial 4 0 international <<opt>>license<<end>>"""),
)

#: A text is matched only if it has one of these; every template and phrase does.
TRIGGERS = (b"license", b"permi", b"released", b"redistrib", b"free")

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """Automaton over words: ``steps[s]`` maps a word to states, ``anyword[s]`` lists states
    that any word leads to; ``depth[s]`` counts the mandatory words before state s."""

    def __init__(self, markup: str):
        self.steps: list[dict] = [{}]
        self.anyword: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]  # moves that read no word
        self.depth = [0]
        self.mandatory = 0
        at, opened = 0, []
        for token in re.findall(r"<<[^>]*>>|[^\s<>]+", markup):
            if token == "<<opt>>":
                opened.append(at)
            elif token == "<<end>>":
                start = opened.pop()
                self.free[start].append(at)
            elif token.startswith("<<any:"):
                last = at
                for _ in range(int(token[6:-2])):
                    new = self._state()
                    self.anyword[last].append(new)
                    last = new
                    at_end = new
                for s in range(at, at_end):
                    self.free[s].append(at_end)
                at = at_end
            else:
                self.mandatory += not opened
                new = self._state()
                self.steps[at].setdefault(token.encode(), []).append(new)
                at = new
        self.accept = at
        self.first = frozenset(w for s in self._closed({0}) for w in self.steps[s])

    def _state(self) -> int:
        self.steps.append({})
        self.anyword.append([])
        self.free.append([])
        self.depth.append(self.mandatory)
        return len(self.steps) - 1

    def _closed(self, states) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def run(self, words: list, start: int) -> tuple[bool, int]:
        """Whether a run of words from ``start`` is accepted; most mandatory words read."""
        states, best = self._closed({0}), 0
        for i in range(start, len(words)):
            word = words[i]
            now = {t for s in states for t in self.steps[s].get(word, ())}
            now |= {t for s in states for t in self.anyword[s]}
            if not now:
                return False, best
            states = self._closed(now)
            best = max(best, max(self.depth[s] for s in now))
            if self.accept in states:
                return True, self.mandatory
        return False, best


_AUTOMATA = [(label, Automaton(markup)) for label, markup in TEMPLATES]
_PHRASES = [(phrase.encode().split(), label) for phrase, label in PHRASES]


def count_words(data: bytes) -> int:
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[1:] = ALNUM_BYTES[np.frombuffer(data, dtype=np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def scan(data: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
    low = data.lower()
    if not any(t in low for t in TRIGGERS):
        return count_words(data), 0, None, None, "", "", 0.0
    words = _WORD.findall(low)
    places, base = [], set()
    where: dict = {}
    for i, w in enumerate(words):
        if w in _STARTS:
            where.setdefault(w, []).append(i)
    for phrase, label in _PHRASES:
        for i in where.get(phrase[0], ()):
            if words[i:i + len(phrase)] == phrase:
                places.append(i)
                base.add(label)
    labels, score = set(base), 0.5 if base else 0.0
    for label, automaton in _AUTOMATA:
        for i in sorted(i for w in automaton.first for i in where.get(w, ())):
            accepted, read = automaton.run(words, i)
            score = max(score, 0.5 * read / automaton.mandatory)
            if accepted:
                labels.add(label)
                score = 1.0
                break
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score)


_STARTS = frozenset(p[0] for p, _ in _PHRASES) | frozenset(w for _, a in _AUTOMATA for w in a.first)

COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _batch(arrays):
    rows = [scan(x) for x in byte_texts(arrays[0])]
    return [list(x) for x in zip(*rows, strict=True)]


def find_licenses(docs: DataFrame, text_col: str = "text", prefix: str | None = None) -> DataFrame:
    """``docs`` and, under ``prefix``, the columns ``COLUMNS``."""
    p = private(docs) if prefix is None else prefix
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType()]
    fields = [T.StructField(p + n, k, True) for n, k in zip(COLUMNS, kinds, strict=True)]
    return arrow_rows(docs, [text_col], _batch, fields)
