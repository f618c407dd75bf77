"""License scans by template markup.

A template is wording with optional regions <<opt>>...<</opt>>, replaceable regions <<var:least-most>> (so many words
of any kind) and <<alt:one|some other>>, whose wordings may have several words. It compiles to a token automaton; all templates run as one automaton whose
deterministic states are made as they are met. A place is accepted only if every mandatory word matches exactly.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, map_rows

# The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of common public license notices and whole license texts.
GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
CONDITIONS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
LATER = "as published by the free software foundation either version <<var:1-2>> of the license or <<opt>>at your option<</opt>> any later version"
RETAINED = (
    CONDITIONS + " <<opt>>1<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " <<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
DISCLAIMED = (
    "this software is provided by <<var:1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    " in no event shall <<var:1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits"
    " or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
TEMPLATES = {
    "mit-notice": "<<alt:released|licensed|distributed|made available|available>> under the <<opt>>terms of the<</opt>> mit license",
    "apache-2.0-notice": "licensed under the apache license <<opt>>version<</opt>> 2 0",
    "cc-by-nc-4.0-notice": "licensed under <<opt>>a<</opt>> cc by nc <<opt>>4 0<</opt>>",
    "cc-by-notice": "licensed under <<opt>>a<</opt>> creative commons attribution <<opt>>4 0<</opt>> <<opt>>international<</opt>> license",
    "cc-by-sa-notice": "licensed under <<opt>>a<</opt>> creative commons attribution <<alt:sharealike|share alike>> <<opt>>4 0<</opt>> <<opt>>international<</opt>> license",
    "gpl-3.0-notice": "licensed under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>version<</opt>> 3",
    "gpl-or-later-notice": "under the terms of the gnu general public license " + LATER,
    "lgpl-or-later-notice": "under the terms of the gnu <<alt:lesser|library>> general public license " + LATER,
    "agpl-or-later-notice": "under the terms of the gnu affero general public license " + LATER,
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<alt:http|https>> www apache org licenses license 2 0"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license"
    ),
    "copyright-line": "copyright <<opt>>c<</opt>> <<var:1-20>> all rights reserved",
    "mit-text": GRANT,
    "mit": (
        GRANT + " and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>>"
        " shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"
        " fitness for a particular purpose and noninfringement in no event shall the <<alt:authors or copyright holders|copyright holders>> be liable for any claim damages or other liability whether in an action of contract tort"
        " or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "bsd-text": CONDITIONS,
    "bsd-2-clause": f"{RETAINED} {DISCLAIMED}",
    "bsd-3-clause": f"{RETAINED} <<opt>>3<</opt>> neither the name of <<var:1-12>> nor the names of <<alt:its|the>> contributors may be used to endorse or promote products derived from this software without specific prior written permission {DISCLAIMED}",
    "isc": (
        "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and <<var:1-6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var:1-6>> be liable for any special"
        " direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the"
        " use or performance of this software"
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the <<alt:authors|author>> be held liable for any damages arising from the use of this software permission is granted to anyone to"
        " use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not"
        " claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as"
        " such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose"
        " commercial or non commercial and by any means"
    ),
    "warranty-disclaimer": "the software is provided <<alt:as is|with all faults>> without warranty of any kind <<opt>>express or implied<</opt>>",
    "spdx-line": "spdx license identifier <<var:1-4>>",
}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def words_of(text: str | None) -> list[str]:
    return WORDS(text.translate(LOWER_TABLE)) if text else []


def parse(template: str) -> list:
    """Nested parts: a word, ('opt', parts), ('var', least, most) or ('alt', wordings), each of them words."""
    stack: list[list] = [[]]
    for tag, word in re.findall(r"<<(.*?)>>|(\S+)", template.replace("<<", " <<").replace(">>", ">> ")):
        if word:
            stack[-1] += words_of(word)
        elif tag == "opt":
            stack.append([])
        elif tag == "/opt":
            if len(stack) == 1:
                raise ValueError(f"<</opt>> without <<opt>>: {template}")
            stack[-2].append(("opt", stack.pop()))
        elif tag.startswith("var:"):
            least, most = map(int, tag[4:].split("-"))
            stack[-1].append(("var", least, most))
        elif tag.startswith("alt:"):
            wordings = tuple(tuple(words_of(x)) for x in tag[4:].split("|"))
            if () in wordings:
                raise ValueError(f"an alternative has no word: {template}")
            stack[-1].append(("alt", wordings))
        else:
            raise ValueError(f"unknown markup <<{tag}>>")
    if len(stack) != 1:
        raise ValueError(f"<<opt>> isn't closed: {template}")
    return stack[0]


def as_regex(template: str) -> str:
    """The template as a regular expression over ' word word ... ' (for SQL engines and tests)."""

    def of(parts: list) -> str:
        out = ""
        for p in parts:
            if isinstance(p, str):
                out += p + " "
            elif p[0] == "opt":
                out += f"(?:{of(p[1])})?"
            elif p[0] == "alt":
                out += f"(?:{'|'.join(' '.join(w) for w in p[1])}) "
            else:
                out += f"(?:[^ ]+ ){{{p[1]},{p[2]}}}"
        return out

    return " " + of(parse(template))


class TokenAutomaton:
    """All templates as one automaton over words; step() determinises lazily."""

    def __init__(self, templates: dict[str, str]):
        self.by_word: list[dict[str, list[int]]] = []
        self.by_any: list[list[int]] = []
        self.free: list[list[int]] = []  # moves that read no word
        self.label: dict[int, str] = {}
        self.root = self.state()
        for label, template in templates.items():
            start = self.state()
            self.free[self.root].append(start)
            self.label[self.build(parse(template), start)] = label
        self.start = self.closure([self.root])
        self.moves: dict[tuple[frozenset, str], frozenset] = {}
        self.first = {w for s in self.start for w in self.by_word[s]}
        if any(self.by_any[s] for s in self.start):
            raise ValueError("a template must begin with wording")

    def state(self) -> int:
        self.by_word.append({})
        self.by_any.append([])
        self.free.append([])
        return len(self.free) - 1

    def build(self, parts: list, at: int) -> int:
        for p in parts:
            to = self.state()
            if isinstance(p, str):
                self.by_word[at].setdefault(p, []).append(to)
            elif p[0] == "alt":
                for wording in p[1]:
                    self.free[self.build(list(wording), at)].append(to)
            elif p[0] == "opt":
                self.free[at].append(to)
                self.free[self.build(p[1], at)].append(to)
            else:
                for k in range(p[2]):
                    if k >= p[1]:
                        self.free[at].append(to)
                    step = self.state()
                    self.by_any[at].append(step)
                    at = step
                self.free[at].append(to)
            at = to
        return at

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset, word: str) -> frozenset:
        known = any(word in self.by_word[s] for s in states)
        key = (states, word if known else "")
        to = self.moves.get(key)
        if to is None:
            to = self.closure([t for s in states for t in [*self.by_word[s].get(word, ()), *self.by_any[s]]])
            self.moves[key] = to
        return to

    def at(self, words: list[str], i: int) -> dict[str, int]:
        """Labels accepted from word i on, with the end of the longest match of each."""
        found, states = {}, self.start
        for j in range(i, len(words)):
            states = self.step(states, words[j])
            if not states:
                break
            for s in states:
                if s in self.label:
                    found[self.label[s]] = j + 1
        return found


class LicenseScanner:
    def __init__(self, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None):
        self.automaton = TokenAutomaton(TEMPLATES if templates is None else templates)
        self.phrases: dict[str, list[tuple[list[str], str]]] = {}
        for p, label in (BASE_PHRASES if phrases is None else phrases).items():
            self.phrases.setdefault(p.split()[0], []).append((p.split(), label))
        self.starts = self.automaton.first | self.phrases.keys()

    def __call__(self, text: str | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Number of words; base places and template places as (first word, end, label)."""
        words = words_of(text)
        base, accepted, starts = [], [], self.starts
        for i in [i for i, w in enumerate(words) if w in starts]:
            for phrase, label in self.phrases.get(words[i], ()):
                if words[i : i + len(phrase)] == phrase:
                    base.append((i, i + len(phrase), label))
            if words[i] in self.automaton.first:
                accepted += [(i, end, label) for label, end in sorted(self.automaton.at(words, i).items())]
        return len(words), base, accepted


def scan_places(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every place of a base phrase or template: the operator's own output. Cases as scan_licenses()."""

    def start() -> Callable[..., tuple]:
        scan = LicenseScanner(templates)

        def one(key, text):
            _, base, accepted = scan(text)
            return key, [{"first_word": a, "end_word": b, "label": c, "base": k} for k, places in ((True, base), (False, accepted)) for a, b, c in places]

        return one

    schema = "doc_id long, places array<struct<first_word:long,end_word:long,label:string,base:boolean>>"
    return map_rows(docs, [F.col(id_col).cast("long"), F.col(text_col)], schema, start).select("doc_id", F.explode("places").alias("p")).select("doc_id", "p.*")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the base places and all labels.

    Null and empty texts have no words, null first and last word, empty labels and score 0; a null id stays null;
    repeated rows each get their row; an empty table gives no rows; other columns are ignored. The score is 1 if a template's mandatory wording
    matches exactly, 0.5 if only a base phrase stands there, else 0. Each row is scanned on its own: no shuffle.
    """

    def start() -> Callable[..., tuple]:
        scan = LicenseScanner(templates)

        def one(key, text):
            n, base, accepted = scan(text)
            labels = sorted({p[2] for p in base})
            score = 1.0 if accepted else 0.5 if base else 0.0
            return key, n, len(base), base[0][0] if base else None, max(p[0] for p in base) if base else None, ",".join(labels), ",".join(sorted({*labels, *(p[2] for p in accepted)})), score

        return one

    return map_rows(docs, [F.col(id_col).cast("long"), F.col(text_col)], SCHEMA, start)
