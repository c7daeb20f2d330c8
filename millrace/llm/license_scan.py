"""License scans by template markup: optional and replaceable regions compiled into token automata.

Markup: [[ ... ]] is optional, {{a..b}} stands for a to b words of any wording; all else must stand as it is.
Templates are tokenised by the rule that texts are, and become one nondeterministic automaton over words.
"""

import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame

from millrace.llm.common import id_and_text, map_rows

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label -> wordings of notices and of licence texts' granting clauses.
TEMPLATES = {
    "mit-notice": [
        "[[this {{1..3}} is]] released under the [[terms of the]] MIT license",
        "[[this {{1..3}} is]] licensed under the [[terms of the]] MIT license",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this {{1..6}} [[(the \"software\")]], to deal in the software without restriction",
    ],
    "apache-2.0-notice": [
        "licensed under the Apache License, version 2.0 [[(the \"license\")]]",
        "licensed under the Apache License 2.0",
    ],
    "gpl-3.0-notice": [
        "this {{1..3}} is licensed under the GNU General Public License, version 3 [[or any later version]]",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, [[either]] version 3",
    ],
    "gpl-2.0-notice": [
        "this {{1..3}} is licensed under the GNU General Public License, version 2 [[or any later version]]",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, [[either]] version 2",
    ],
    "cc-by-nc-4.0-notice": ["licensed under [[a]] [[Creative Commons]] CC BY-NC 4.0 [[{{1..2}} license]]"],
    "cc-by-4.0-notice": ["licensed under [[a]] [[Creative Commons]] CC BY 4.0 [[{{1..2}} license]]"],
    "mit-text": [
        """[[MIT license]] [[copyright {{1..12}}]] permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files [[(the "software")]], to deal in the software without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished
        to do so, subject to the following conditions: the above copyright notice and this permission notice [[(including the next paragraph)]] shall be
        included in all copies or substantial portions of the software. the software is provided "as is", without warranty of any kind, express or implied,
        including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall {{1..8}} be
        liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with
        the software or the use or other dealings in the software"""
    ],
    "isc-text": [
        """permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. the software is provided "as is" and {{1..6}} disclaims all warranties with regard
        to this software including all implied warranties of merchantability and fitness. in no event shall {{1..6}} be liable for any special, direct,
        indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract,
        negligence or other tortious action, arising out of or in connection with the use or performance of this software"""
    ],
    "apache-2.0-header": [
        """licensed under the Apache License, version 2.0 (the "license"); you may not use this file except in compliance with the license. you may obtain
        a copy of the license at [[http]] [[https]] www.apache.org/licenses/license-2.0 [[.html]] unless required by applicable law or agreed to in writing,
        software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied.
        see the license for the specific language governing permissions and limitations under the license"""
    ],
    "gpl-2.0-or-later-header": [
        """this {{1..4}} is free software[[;]] you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation; either version 2 of the license, or (at your option) any later version"""
    ],
    "gpl-3.0-or-later-header": [
        """this {{1..4}} is free software[[;]] you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation, either version 3 of the license, or (at your option) any later version"""
    ],
    "lgpl-2.1-or-later-header": [
        """this {{1..4}} is free software[[;]] you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published
        by the Free Software Foundation; either version 2.1 of the license, or (at your option) any later version"""
    ],
    "bsd-2-clause-text": [
        """redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
        [[1]] redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
        [[2]] redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution this software is provided by {{1..8}} "as is" and any express or implied
        warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""
    ],
    "bsd-3-clause-text": [
        """redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
        [[1]] redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
        [[2]] redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution [[3]] neither the name of {{1..8}} nor the names of its contributors may be used
        to endorse or promote products derived from this software without specific prior written permission"""
    ],
    "bsd-notice": ["redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
}
_SPACED = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_template long"


def words_of(body: bytes | None) -> list[bytes]:
    return (body or b"").lower().translate(_SPACED).split()


class Automaton:
    """States are numbers; step[s]: word -> next states, any[s]: next states on any word, label[s]: accepted."""

    def __init__(self, templates: dict[str, list[str]]):
        self.step, self.any, self.free, self.label = [], [], [], {}
        self.starts: dict[bytes, set[int]] = {}
        self.anchors: set[bytes] = set()
        for label, wordings in templates.items():
            for wording in wordings:
                self._add(label, wording)
        self.closed = [self._closure(s) for s in range(len(self.step))]

    def _state(self) -> int:
        self.step.append({})
        self.any.append(set())
        self.free.append(set())
        return len(self.step) - 1

    def _add(self, label: str, wording: str) -> None:
        at = first = self._state()
        opened, must = [], []
        for part in re.split(r"(\[\[|\]\]|\{\{\d+\.\.\d+\}\})", wording):
            if part == "[[":
                opened.append(at)
            elif part == "]]":
                self.free[opened.pop()].add(at)
            elif gap := re.fullmatch(r"\{\{(\d+)\.\.(\d+)\}\}", part):
                least, most = map(int, gap.groups())
                passed = []
                for _ in range(most):
                    passed.append(at)
                    to = self._state()
                    self.any[at].add(to)
                    at = to
                for s in passed[least:]:
                    self.free[s].add(at)
            else:
                for word in words_of(part.encode()):
                    to = self._state()
                    self.step[at].setdefault(word, set()).add(to)
                    at = to
                    if not opened:
                        must.append(word)
                # an optional region is left by the state after its last word
        self.label.setdefault(at, set()).add(label)
        self.anchors.add(max(must, key=len))
        for s in self._closure(first):
            for word in self.step[s]:
                self.starts.setdefault(word, set()).add(s)

    def _closure(self, s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for to in self.free[todo.pop()] - seen:
                seen.add(to)
                todo.append(to)
        return frozenset(seen)

    def matches(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(first word's place, label) of each accepted stretch."""
        found = set()
        for place, word in enumerate(words):
            now = self.starts.get(word)
            at = place
            while now:
                following: set[int] = set()
                for s in now:
                    for to in (*self.step[s].get(words[at], ()), *self.any[s]):
                        following |= self.closed[to]
                for s in following & self.label.keys():
                    found |= {(place, x) for x in self.label[s]}
                at += 1
                now = following if at < len(words) else None
        return sorted(found)


def scan(body: bytes | None, phrases: list[tuple[bytes, str]], automaton: Automaton) -> tuple:
    words = words_of(body)
    base, own = [], []
    joined = b" " + b" ".join(words) + b" " if body else b""
    starts = None
    for phrase, label in phrases:
        at = joined.find(b" " + phrase + b" ")
        while at >= 0:
            if starts is None:  # where each word stands in joined, counted once
                starts = list(accumulate((len(w) + 1 for w in words), initial=0))
            base.append((bisect_left(starts, at), label))
            at = joined.find(b" " + phrase + b" ", at + 1)
    if any(a in joined for a in automaton.anchors):
        own = automaton.matches(words)
    places, labels = [p for p, _ in base], {x for _, x in base}
    return (
        len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
        ",".join(sorted(labels | {x for _, x in own})), 1.0 if own else 0.5 if base else 0.0, len(own),
    )


def license_scan(df: DataFrame, id_col="doc_id", text_col="text", phrases=None, templates=None) -> DataFrame:
    """Every row's base places and labels. A null or empty text has no words, no places and empty labels. Texts may have
    any length; repeated rows are each told for themselves.

    score: 1 where a template accepts a stretch of the text, 0.5 where only a base phrase stands, else 0.
    n_template: accepted stretches.
    """
    pairs = [(b" ".join(words_of(p.encode())), label) for p, label in (phrases or PHRASES).items()]
    automaton = Automaton(templates or TEMPLATES)

    def run(cols):
        return [cols[0], *map(list, zip(*[scan(b, pairs, automaton) for b in cols[1]]))]

    return map_rows(id_and_text(df, id_col, text_col), run, COLUMNS)
