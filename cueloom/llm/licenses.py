"""License scans by template-markup matching.

A template is a license text with regions marked as in SPDX's markup: <<beginOptional>> ... <<endOptional>> may be left
out, <<var;tokens="a-b">> stands for a to b words of any kind. It is compiled to an automaton over tokens (runs of
letters a-z and digits, case doesn't count, everything between them is equal). A text is accepted where the automaton
takes it from a start: all mandatory words, exactly and in order.

Only texts that hold a template's longest mandatory word as a substring are tried: no other text can be accepted.

Cases: null ids and null or empty texts give no rows; matches of one license in a text are counted from left to right,
the longest first, without overlap; every text of a repeated doc_id is scanned, and equal rows are listed once; very long
texts are scanned whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

_OPT, _END = "<<beginOptional>>", "<<endOptional>>"

_WHO = '<<var;name="holder";original="the copyright holders and contributors";tokens="1-20">>'
_BSD_1 = f"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {_OPT}1.{_END} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {_OPT}2.{_END} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_AD = f"{_OPT}3.{_END} All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by {_WHO}. "
_BSD_NAME = f"{{n}} Neither the name of {_WHO} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = f" THIS SOFTWARE IS PROVIDED BY {_WHO} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {_WHO} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = f"under the {_OPT}terms of the{_END} GNU"
_LATER = f"{_OPT}of the License or at your option any later version{_END}"

TEMPLATES: dict[str, str] = {
    "Apache-2.0": f"licensed under the Apache License{_OPT},{_END} Version 2.0 {_OPT}(the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0{_END}",
    "MIT": f"released under the {_OPT}terms of the{_END} MIT License",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="software";original="this software and associated documentation files";tokens="1-8">> (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice '
    + f"{_OPT}(including the next paragraph){_END} shall be included in all copies or substantial portions of the Software."
    + f' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {_WHO} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": f"Permission to use, copy, modify, and{_OPT}/or{_END} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND {_WHO} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {_WHO} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": _BSD_1 + _BSD_END,
    "BSD-3-Clause-text": _BSD_1 + _BSD_NAME.format(n=f"{_OPT}3.{_END}") + _BSD_END,
    "BSD-4-Clause-text": _BSD_1 + _BSD_AD + _BSD_NAME.format(n=f"{_OPT}4.{_END}") + _BSD_END,
    "GPL-2.0": f"licensed {_GNU} General Public License {_OPT}as published by the Free Software Foundation either{_END} version 2 {_LATER}",
    "LGPL-2.1": f"licensed {_GNU} Lesser General Public License {_OPT}as published by the Free Software Foundation either{_END} version 2.1 {_LATER}",
    "LGPL-3.0": f"licensed {_GNU} Lesser General Public License {_OPT}as published by the Free Software Foundation either{_END} version 3 {_LATER}",
    "MPL-2.0": f"subject to the terms of the Mozilla Public License, v{_OPT}.{_END} 2.0",
    "CC-BY-4.0": f"licensed under {_OPT}a{_END} {_OPT}Creative Commons{_END} CC BY 4.0 {_OPT}International License{_END}",
    "CC-BY-SA-4.0": f"licensed under {_OPT}a{_END} {_OPT}Creative Commons{_END} CC BY-SA 4.0 {_OPT}International License{_END}",
    "GPL-3.0": f"licensed under the {_OPT}terms of the{_END} GNU General Public License {_OPT}as published by the Free Software Foundation either{_END} version 3 {_OPT}of the License or at your option any later version{_END}",
    "CC-BY-NC-4.0": f"licensed under {_OPT}a{_END} {_OPT}Creative Commons{_END} CC BY-NC 4.0 {_OPT}International License{_END}",
    "LicenseRef-reserved": f'{_OPT}Copyright {_OPT}(c){_END} <<var;name="holder";original="year holder";tokens="1-6">>{_END} All rights reserved',
}

_MARK = re.compile(r"<<(.*?)>>", re.S)
_TOKEN = re.compile(r"[a-z0-9]+")


def parse(markup: str) -> list:
    """Nested items: a word, ("var", least, most), ("opt", [items])."""
    stack, at = [[]], 0
    for m in [*_MARK.finditer(markup), None]:
        stack[-1] += _TOKEN.findall(markup[at : m.start() if m else len(markup)].lower())
        if not m:
            break
        at, tag = m.end(), m[1]
        if tag == "beginOptional":
            stack.append([])
        elif tag == "endOptional":
            if len(stack) == 1:
                raise ValueError("an optional region ends that didn't begin")
            done = stack.pop()
            stack[-1].append(("opt", done))
        elif tag.startswith("var;"):
            lo, hi = (re.search(r'tokens="(\d+)-(\d+)"', tag) or re.match("()()", "")).groups() or ("", "")
            stack[-1].append(("var", int(lo or 0), int(hi or 20)))
        else:
            raise ValueError(f"unknown markup {tag!r}")
    if len(stack) != 1:
        raise ValueError("an optional region doesn't end")
    return stack[0]


class Automaton:
    """Non-deterministic over tokens: steps[state] = {word: next}, any_[state] = next for any word, skip[state] = nexts without one."""

    def __init__(self, items: list):
        self.steps: list[dict] = [{}]
        self.any_: list[int | None] = [None]
        self.skip: list[list[int]] = [[]]
        self.final = self._add(items, 0)
        self.closed = [self._closure({s}) for s in range(len(self.steps))]
        self.must = [x for x in items if isinstance(x, str)]
        if not self.must:
            raise ValueError("a template needs a mandatory word")
        starts = self.closed[0]
        self.first = None if any(self.any_[s] is not None for s in starts) else {w for s in starts for w in self.steps[s]}

    def _new(self) -> int:
        self.steps.append({})
        self.any_.append(None)
        self.skip.append([])
        return len(self.steps) - 1

    def _add(self, items: list, s: int) -> int:
        for x in items:
            if isinstance(x, str):
                t = self._new()
                self.steps[s][x] = t
                s = t
            elif x[0] == "var":
                ends = [s] if x[1] == 0 else []
                for k in range(1, x[2] + 1):
                    t = self._new()
                    self.any_[s] = t
                    s = t
                    if k >= x[1]:
                        ends.append(s)
                t = self._new()
                for e in ends:
                    self.skip[e].append(t)
                s = t
            else:
                inner, end = self._new(), self._new()
                self.skip[s] += [inner, end]
                self.skip[self._add(x[1], inner)].append(end)
                s = end
        return s

    def _closure(self, states: set) -> frozenset:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    def longest(self, tokens: list[str], i: int) -> int:
        """One past the last token of the longest match from i, or -1."""
        now, end, n = self.closed[0], -1, len(tokens)
        while now:
            if self.final in now:
                end = i
            if i == n:
                break
            w, nxt = tokens[i], set()
            for s in now:
                if (t := self.steps[s].get(w)) is not None:
                    nxt |= self.closed[t]
                if (t := self.any_[s]) is not None:
                    nxt |= self.closed[t]
            now, i = nxt, i + 1
        return end

    def count(self, tokens: list[str]) -> int:
        i = n = 0
        while i < len(tokens):
            if self.first is None or tokens[i] in self.first:
                end = self.longest(tokens, i)
                if end > i:
                    n, i = n + 1, end
                    continue
            i += 1
        return n


def regex(items: list) -> str:
    """The same language over the text's tokens, each followed by a space, for the SQL check."""
    out = ""
    for x in items:
        out += f"{x} " if isinstance(x, str) else f"(?:[a-z0-9]+ ){{{x[1]},{x[2]}}}" if x[0] == "var" else f"(?:{regex(x[1])})?"
    return out


def needle(items: list) -> str:
    return max((x for x in items if isinstance(x, str)), key=len)


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license_id, occurrences) of every license that a document's text holds."""
    parsed = {k: parse(v) for k, v in (templates or TEMPLATES).items()}
    hints = sorted({needle(x) for x in parsed.values()})

    def find(batches):
        machines = {k: (Automaton(x), needle(x)) for k, x in parsed.items()}
        for b in C.slices(batches):
            rows = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = None
                for k, (m, hint) in machines.items():
                    if hint in text:
                        tokens = _TOKEN.findall(text) if tokens is None else tokens
                        if n := m.count(tokens):
                            rows.append((d, k, n))
            a, l, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(l, pa.string()), pa.array(n, pa.int64())], ["doc_id", "license_id", "occurrences"])

    low = C.with_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    hit = F.lit(False)
    for h in hints:
        hit |= F.col("text").contains(h)
    return low.where(hit).mapInArrow(find, "doc_id long, license_id string, occurrences long").distinct()


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.read(spark, sf_dir, "documents"))


def sql() -> str:
    rows = ", ".join(f"('{k}', '\\b{regex(parse(v))}')" for k, v in TEMPLATES.items())
    return f"""
WITH t(license_id, pattern) AS (VALUES {rows}),
d AS (SELECT DISTINCT doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ' AS s FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
m AS (SELECT doc_id, license_id, len(regexp_extract_all(s, pattern)) AS occurrences FROM d, t)
SELECT DISTINCT doc_id, license_id, CAST(occurrences AS BIGINT) AS occurrences FROM m WHERE occurrences > 0
"""
