"""License scans by template markup.

A template is wording with regions in markup: ``[ ... ]`` may be missing, ``{n}`` stands for any
0 to n words (a name, a year, a version). It is compiled into an automaton over words; a place
in a text matches when the automaton accepts words from there on, so all mandatory wording must
be there exactly. Words are runs of ASCII letters and digits (A-Z lower-cased) and of any
character beyond ASCII; what stands between them doesn't count.

There are templates of whole licenses and of notices that name one. Beside them, base phrases are counted at every place. A
null or empty text has no words, no labels and score 0. A very long text is searched as a whole. Templates
that match at one place all count. Rows that repeat are judged each on its own; an empty table gives no rows; an
input column named like a result gives way.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

#: Phrase -> label. Every place counts.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
_ISC = "permission to use copy modify and [ or ] distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = "the software is provided as is and {5} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {5} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {1} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {1} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "{1} neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_AS_IS = "this software is provided by {8} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {8} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_FREE = "free software you can redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software foundation [ ; ] [ either ] version {} [ of the license ] [ or at your option any later version ]"

#: Label -> templates of whole licenses: all of their wording but names, list marks and the optional parts.
TEXTS = {
    "mit": [f"{_MIT} subject to the following conditions the above copyright notice and this permission notice [ including the next paragraph ] shall be included in all copies or substantial portions of the software {_AS_IS}"],
    "mit-0": [f"{_MIT} {_AS_IS}"],
    "isc": [f"{_ISC} provided that the above copyright notice and this permission notice appear in all copies {_ISC_AS_IS}"],
    "0bsd": [f"{_ISC} {_ISC_AS_IS}"],
    "bsd-2-clause": [f"{_BSD} {_BSD_AS_IS}"],
    "bsd-3-clause": [f"{_BSD} {_BSD_NAMES} {_BSD_AS_IS}"],
}

#: Label -> templates of notices, by which a text says under which license it stands.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license [ , ] version 2 0 [ the license ]", "spdx license identifier apache 2 0"],
    "mit": ["released under the mit license", "licensed under the mit license", "under the terms of the mit license", "spdx license identifier mit"],
    "gpl-3.0": ["licensed under the [ terms of the ] [ gnu ] general public license [ as published by the free software foundation ] [ either ] version 3 [ or any later version ]", "spdx license identifier gpl 3 0", _FREE.format("", 3)],
    "gpl-2.0": ["licensed under the [ terms of the ] [ gnu ] general public license [ as published by the free software foundation ] [ either ] version 2 [ or any later version ]", "spdx license identifier gpl 2 0", _FREE.format("", 2)],
    "lgpl": ["licensed under the [ terms of the ] [ gnu ] lesser general public license", _FREE.format("lesser", "{1}")],
    "agpl": ["licensed under the [ terms of the ] [ gnu ] affero general public license", _FREE.format("affero", "{1}")],
    "bsd": ["released under the [ {2} clause ] bsd license", "licensed under the [ {2} clause ] bsd license"],
    "mpl-2.0": ["subject to the terms of the mozilla public license [ v ] [ version ] 2 0"],
    "isc": ["released under the isc license", "licensed under the isc license", "spdx license identifier isc"],
    "cc-by-nc-4.0": ["licensed under [ a ] [ the ] [ creative commons ] cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 [ international ] license"],
    "cc-by-sa-4.0": ["licensed under [ a ] [ the ] cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 [ international ] license"],
    "cc-by-4.0": ["licensed under [ a ] [ the ] cc by 4 0", "licensed under a creative commons attribution 4 0 [ international ] license"],
    "cc0-1.0": ["dedicated to the public domain under [ the ] cc0", "licensed under cc0 1 0"],
    "copyright": ["copyright [ c ] {6} all rights reserved", "© {6} all rights reserved"],
}

#: Bytes of words stay, A-Z are lower-cased, all others become a space.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

SCHEMA = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())]
)


def fold(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """States 0..n; edges[s] maps a word to the next states, anything[s] are those that any word
    leads to, empty[s] those that no word leads to."""

    def __init__(self, template: str) -> None:
        self.edges: list[dict[bytes, set[int]]] = [{}]
        self.anything: list[set[int]] = [set()]
        self.empty: list[set[int]] = [set()]
        self.mandatory: list[bytes] = []
        at, opened = 0, []
        for part in template.split():
            if part == "[":
                opened.append(at)
            elif part == "]":
                self.empty[opened.pop()].add(at)
            elif m := re.fullmatch(r"\{(\d+)\}", part):
                starts = [at]
                for _ in range(int(m[1])):
                    new = self._state()
                    self.anything[at].add(new)
                    at = new
                    starts.append(at)
                for s in starts[:-1]:
                    self.empty[s].add(at)
            else:
                for word in fold(part.encode()):
                    new = self._state()
                    self.edges[at].setdefault(word, set()).add(new)
                    at = new
                    if not opened:
                        self.mandatory.append(word)
        self.accept = at
        self.first = set(self.edges[0])
        if self.empty[0] or self.anything[0]:
            raise ValueError(f"a template begins with mandatory wording: {template}")

    def _state(self) -> int:
        self.edges.append({})
        self.anything.append(set())
        self.empty.append(set())
        return len(self.edges) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def end(self, words: list[bytes], at: int) -> int:
        """Where the longest match from `at` ends; -1 for none."""
        states, found = self._closed({0}), -1
        for k in range(at, len(words)):
            new: set[int] = set()
            for s in states:
                new |= self.anything[s]
                new |= self.edges[s].get(words[k], set())
            if not new:
                break
            states = self._closed(new)
            if self.accept in states:
                found = k + 1
        return found


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, base: dict[str, str] = BASE, texts: dict[str, list[str]] = TEXTS) -> None:
        self.base = [(fold(p.encode()), label) for p, label in base.items()]
        self.begin: dict[bytes, list[tuple[str, bool, Automaton]]] = {}
        gates = {max(p, key=len) for p, _ in self.base}
        for label, whole, each in [*((k, False, v) for k, v in templates.items()), *((k, True, v) for k, v in texts.items())]:
            for template in each:
                a = Automaton(template)
                gates.add(max(a.mandatory, key=len))
                for word in a.first:
                    self.begin.setdefault(word, []).append((label, whole, a))
        #: A text that holds none of these bytes can match nothing.
        self.gate = re.compile(b"|".join(re.escape(g) for g in sorted(gates)))

    def places(self, words: list[bytes], phrase: list[bytes]) -> list[int]:
        found, at = [], -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                return found
            if words[at : at + len(phrase)] == phrase:
                found.append(at)

    def spans(self, words: list[bytes]) -> list[tuple[int, int, str, bool]]:
        """(start, end, label, whole) of every place where a template matches; whole: that of a license, not of a notice."""
        out = []
        for word, each in self.begin.items():
            at = -1
            while True:
                try:
                    at = words.index(word, at + 1)
                except ValueError:
                    break
                out += [(at, end, label, whole) for label, whole, a in each if (end := a.end(words, at)) >= 0]
        return sorted(set(out))

    def scan(self, text: bytes) -> tuple:
        folded = text.translate(_FOLD)
        words = folded.split()
        if not self.gate.search(folded):
            return len(words), 0, None, None, "", "", 0.0
        places, labels = [], set()
        for phrase, label in self.base:
            if found := self.places(words, phrase):
                places += found
                labels.add(label)
        spans = self.spans(words)
        own = {label for _, _, label, _ in spans}
        score = 1.0 if any(whole for *_, whole in spans) else 0.75 if own else 0.5 if labels else 0.0
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own)), score


@lru_cache(1)
def _scanner() -> Scanner:
    return Scanner()


def _work(batch: list[bytes]) -> dict:
    rows = [_scanner().scan(t) for t in batch]
    return dict(zip(SCHEMA.fieldNames(), map(list, zip(*rows, strict=True)), strict=True))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, with the columns of SCHEMA. score: 1 where a whole license
    stands, 0.75 where a notice does, 0.5 where base phrases alone do."""
    return common.map_texts(docs, _work, SCHEMA, text_col)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _pattern(template: str) -> str:
    """A template as a regular expression over words that each have a space before them."""
    out = ""
    for part in template.split():
        if part == "[":
            out += "(?:"
        elif part == "]":
            out += ")?"
        elif m := re.fullmatch(r"\{(\d+)\}", part):
            out += f"(?: [^ ]+){{0,{m[1]}}}"
        else:
            out += "".join(f" {w.decode()}" for w in fold(part.encode()))
    # signs alone leave an empty region
    return out.replace("(?:)?", "") + " "


_ALL = {label: [*TEMPLATES.get(label, []), *TEXTS.get(label, [])] for label in [*TEMPLATES, *(k for k in TEXTS if k not in TEMPLATES)]}


def _op8_sql() -> str:
    tests = ",\n".join(f"CASE WHEN regexp_matches(s, '{'|'.join(_pattern(t) for t in each)}') THEN '{label}' END" for label, each in _ALL.items())
    whole = " OR ".join(f"regexp_matches(s, '{_pattern(t)}')" for each in TEXTS.values() for t in each)
    base = ",\n".join(f"CASE WHEN contains(s, ' {p} ') THEN '{label}' END" for p, label in BASE.items())
    starts = " UNION ALL ".join(f"SELECT r, i FROM x WHERE w = '{p.split()[0]}' AND list_slice(words, i + 1, i + {len(p.split())}) = {p.split()!r}" for p in BASE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words FROM documents),
s AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS s FROM d),
x AS (SELECT r, words, words[i + 1] AS w, i FROM (SELECT r, words, unnest(range(len(words))) AS i FROM s WHERE {" OR ".join(f"contains(s, ' {p} ')" for p in BASE)})),
p AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS b FROM ({starts}) GROUP BY r),
l AS (SELECT *, list_filter([{base}], lambda y: y IS NOT NULL) AS bl, list_filter([{tests}], lambda y: y IS NOT NULL) AS ml FROM s)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word,
  array_to_string(list_sort(bl), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(bl, ml))), ',') AS labels,
  CASE WHEN {whole} THEN 1.0::DOUBLE WHEN len(ml) > 0 THEN 0.75::DOUBLE WHEN len(bl) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM l LEFT JOIN p USING (r)
"""


OP8_SQL = _op8_sql()
