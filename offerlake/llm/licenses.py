"""License scans by matching template markup.

A template is license wording with marks: ``<<beginOptional>> ... <<endOptional>>`` around words that may be missing and
``<<var;match="...">>`` for words that may be replaced, where match is ``.+`` (a word at least), ``.*`` (any words) or
``.{m,n}`` (m to n words). It is compiled into an automaton over words in lower case, without punctuation and with spelling
variants folded. A text is accepted where all the mandatory wording stands word for word, from an optional or mandatory
first word to the last that the automaton can reach; a replaceable region of any length is as short as it can be.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm import columnar as C

SCHEMA = "doc_id bigint, license string, first_word int, n_words int"
VARIANTS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "favour": "favor", "organisation": "organization"}
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var)(?:;[^>]*?match=\"([^\"]*)\")?[^>]*>>")
_AS_IS = "is provided as is without warranty of any kind"

TEMPLATES: dict[str, str] = {
    "MIT-notice": '<<beginOptional>>this <<var;match=".{1,3}">> is<<endOptional>> <<beginOptional>>released<<endOptional>><<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License',
    "Apache-2.0-notice": 'Licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License, <<beginOptional>>Version<<endOptional>> 2.0 <<beginOptional>>(the "License"); you may not use this file except in compliance with the License<<endOptional>>',
    "GPL-3.0-notice": '<<beginOptional>>This work is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version 3 <<beginOptional>>of the License<<endOptional>> <<beginOptional>>or <<beginOptional>>(at your option)<<endOptional>> any later version<<endOptional>>',
    "GPL-2.0-notice": '<<beginOptional>>This work is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version 2 <<beginOptional>>of the License<<endOptional>> <<beginOptional>>or <<beginOptional>>(at your option)<<endOptional>> any later version<<endOptional>>',
    "CC-BY-4.0-notice": "<<beginOptional>>This work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons Attribution<<endOptional>><<beginOptional>>CC BY<<endOptional>> 4.0 <<beginOptional>>International License<<endOptional>>",
    "CC-BY-NC-4.0-notice": "<<beginOptional>>This work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons Attribution<<endOptional>><<beginOptional>>CC BY<<endOptional>> <<beginOptional>>NC<<endOptional>><<beginOptional>>NonCommercial<<endOptional>> 4.0 <<beginOptional>>International License<<endOptional>>",
    "all-rights-reserved": '<<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;match=".{1,12}">><<endOptional>> All rights reserved',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE ' + _AS_IS + ', EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;match=".+">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE',
    "ISC": 'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;match=".+">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;match=".{0,1}">> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<var;match=".{0,1}">> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution',
}


@dataclass
class Automaton:
    """Word automaton: steps[state] are (word or None for any, next state); skips[state] are moves without a word."""

    steps: list[list[tuple[str | None, int]]] = field(default_factory=lambda: [[]])
    skips: list[list[int]] = field(default_factory=lambda: [[]])
    mandatory: list[str] = field(default_factory=list)
    #: First state of a region of any length, and first one behind all mandatory words.
    loop: int = 1 << 62
    complete: int = 0

    def state(self) -> int:
        self.steps.append([])
        self.skips.append([])
        return len(self.steps) - 1

    def close(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def finish(self) -> Automaton:
        self.final = len(self.steps) - 1
        self.start = self.close({0})
        self.moves: dict[tuple[frozenset[int], str | None], frozenset[int]] = {}
        self.words = {w for row in self.steps for w, _ in row if w}
        self.opening = {w for s in self.start for w, _ in self.steps[s] if w}
        return self

    def move(self, states: frozenset[int], word: str) -> frozenset[int]:
        key = (states, word if word in self.words else None)
        if key not in self.moves:
            self.moves[key] = self.close({n for s in states for w, n in self.steps[s] if w is None or w == word})
        return self.moves[key]

    def longest(self, words: list[str], at: int, loops: bool = True) -> int:
        """Words from `at` on to the furthest accepted place; 0 if none is.

        Without loops, a region of any length ends where the wording behind it first stands, so that a later place of the
        same template is left for a match of its own; only optional words at the end can go on from there.
        """
        states, end = self.start, 0
        for i in range(at, len(words)):
            states = self.move(states, words[i])
            if not states:
                break
            if self.final in states:
                end = i + 1 - at
                if not loops:
                    states = frozenset(s for s in states if s < self.loop or s >= self.complete)
        return end


def fold(text: str) -> list[str]:
    return [VARIANTS.get(w, w) for w in _WORD.findall(text.lower())]


def compile_template(template: str) -> Automaton:
    """The automaton of a template. Marks must be balanced; leading and trailing replaceable regions are an error."""
    machine, at, opened, last = Automaton(), 0, [], 0
    pieces: list[tuple[str, str | None]] = []
    for mark in _MARK.finditer(template):
        pieces += [("text", template[last : mark.start()]), (mark[1], mark[2])]
        last = mark.end()
    pieces.append(("text", template[last:]))
    shape = [k for k, v in pieces if k != "text" or _WORD.search(v)]
    if not shape or shape[0] == "var" or shape[-1] == "var":
        raise ValueError("a template begins and ends with words")
    for kind, value in pieces:
        if kind == "text":
            for word in fold(value):
                following = machine.state()
                machine.steps[at].append((word, following))
                at = following
                if not opened:
                    machine.mandatory.append(word)
                    machine.complete = at
        elif kind == "beginOptional":
            inner = machine.state()
            machine.skips[at].append(inner)
            opened.append(at)
            at = inner
        elif kind == "endOptional":
            outer = machine.state()
            machine.skips[at].append(outer)
            machine.skips[opened.pop()].append(outer)
            at = outer
        else:
            bounds = re.fullmatch(r"\.(?:([+*])|\{(\d+),(\d+)\})", value or ".+")
            if not bounds:
                raise ValueError(f"match {value!r} isn't .+, .* or .{{m,n}}")
            least = int(bounds[2]) if bounds[2] else int(bounds[1] == "+")
            for _ in range(least):
                following = machine.state()
                machine.steps[at].append((None, following))
                at = following
            if bounds[1]:
                loop = machine.state()
                machine.loop = min(machine.loop, loop)
                machine.skips[at].append(loop)
                machine.steps[loop].append((None, loop))
                at = loop
            else:
                ends = [at]
                for _ in range(int(bounds[3]) - least):
                    following = machine.state()
                    machine.steps[at].append((None, following))
                    at = following
                    ends.append(at)
                for e in ends[:-1]:
                    machine.skips[e].append(at)
    if opened:
        raise ValueError("beginOptional without endOptional")
    if not machine.mandatory:
        raise ValueError("a template has mandatory words")
    end = machine.state()
    machine.skips[at].append(end)
    return machine.finish()


def find(words: list[str], machine: Automaton) -> list[tuple[int, int]]:
    """First word and number of words of each match, by longest() without loops: from the left, none overlapping."""
    out, free = [], 0
    for i, word in enumerate(words):
        if word in machine.opening and i >= free:
            n = machine.longest(words, i, loops=False)
            if n:
                out.append((i, n))
                free = i + n
    return out


def spellings(word: str) -> list[str]:
    return [word, *[v for v, w in VARIANTS.items() if w == word and v != word]]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each place where a text has a template's wording: license, first word (from 0) and number of words.

    Whole texts are scanned. A document without a match (null and empty texts, too) has no row; a null id stays null;
    repeated rows each give theirs; other columns aren't read. Only texts that contain a template's longest mandatory word
    leave the JVM. Nothing is shuffled.
    """
    templates = TEMPLATES if templates is None else templates
    C.small_batches(docs.sparkSession)
    anchors = {name: max(compile_template(t).mandatory, key=len) for name, t in templates.items()}

    def run(batches):
        machines = {name: (compile_template(t), spellings(anchors[name])) for name, t in templates.items()}
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                lowered, words = text.lower(), None
                for name, (machine, needed) in machines.items():
                    if any(w in lowered for w in needed):
                        words = fold(text) if words is None else words
                        rows += [(i, name, at, n) for at, n in find(words, machine)]
            if rows:
                at, name, first, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(name), pa.array(first, pa.int32()), pa.array(n, pa.int32())], names=["doc_id", "license", "first_word", "n_words"])

    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    lowered = F.lower("text")
    needed = sorted({s for word in anchors.values() for s in spellings(word)})
    source = source.filter(reduce(lambda a, b: a | b, [lowered.contains(w) for w in needed]))
    return source.mapInArrow(run, SCHEMA)


def as_regex(template: str) -> str:
    """A template as a regular expression over text in which each word stands as <word>; for the SQL check."""
    out, last = [], 0

    def text(value: str) -> str:
        return "".join("<" + ("(?:" + "|".join(spellings(w)) + ")" if len(spellings(w)) > 1 else w) + ">" for w in fold(value))

    for mark in _MARK.finditer(template):
        out.append(text(template[last : mark.start()]))
        if mark[1] == "var":
            bounds = {".+": "+?", ".*": "*?"}.get(mark[2] or ".+") or mark[2][1:]
            out.append(f"(?:<[^<>]+>){bounds}")
        else:
            out.append("(?:" if mark[1] == "beginOptional" else ")?")
        last = mark.end()
    return "".join([*out, text(template[last:])])


def sql() -> str:
    """The scan in DuckDB's SQL: matches of each template's expression over marked words, with their places."""
    patterns = ", ".join(f"('{name}', '{as_regex(t)}')" for name, t in TEMPLATES.items())
    return f"""
WITH marked AS (
  SELECT doc_id, '<' || array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), '><') || '>' AS words FROM documents
  WHERE regexp_matches(lower(text), 'licen|reserved|permission|redistribution|distribut|copies')
), patterns(license, pattern) AS (VALUES {patterns}), cut AS (
  SELECT doc_id, license, regexp_extract_all(words, pattern) AS found, string_split_regex(words, pattern) AS between
  FROM marked, patterns
), each AS (
  SELECT doc_id, license, found, between, unnest(range(1, len(found) + 1)) AS k FROM cut WHERE len(found) > 0
)
SELECT doc_id, license,
  CAST(list_sum(list_transform(between[1:k], lambda x: len(x) - len(replace(x, '<', ''))))
    + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: len(x) - len(replace(x, '<', '')))), 0) AS INT) AS first_word,
  CAST(len(found[k]) - len(replace(found[k], '<', '')) AS INT) AS n_words
FROM each
"""
