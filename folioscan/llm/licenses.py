"""License scan: templates with optional and replaceable regions, matched as token automata.

Template markup: ``<<opt>>`` ... ``<<end>>`` encloses wording that may be missing, ``<<var:name:a-b>>`` stands
for any a to b words. What else a template says is mandatory and must stand in the text word for
word. A word is one of ``textvec``: case, punctuation and line breaks don't count, so that wrapped and
commented notices are found; spellings that the guidelines for matching treat as equal (licence and license,
and the like) are made equal in template and text.

A template becomes an automaton over words: states joined by word edges, by edges for any word
(with counted states for their bounds) and by empty edges past optional regions. A document is
looked at by an automaton only where it holds every mandatory run of the template (three words, or the
whole stretch where that is shorter). One vectorised pass over all words looks for one run of each
template, that with the longest words; only texts that hold it are searched for the others. The
automaton then starts at each word that can come first. Matches of a template are the leftmost, of those the longest, and don't
overlap. Replaceable words at a template's end go no further than to where it matches anew.

Defined cases: null and empty texts match nothing; a template without mandatory words is an
error; rows that repeat give their matches each; several templates may match the same words; an
empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import small_batches
from folioscan.llm.textvec import batches, shingles, slices, word_hashes

_EQUAL = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "favour": "favor", "organisation": "organization", "whilst": "while", "centre": "center", "merchantibility": "merchantability"}
_MARK = re.compile(r"<<(opt|end|var:\w+:\d+-\d+)>>")

#: Whole licenses, a file each, in the wording of their publishers; only numbering, appendices and the like are optional.
TEXTS = Path(__file__).with_name("license_texts")

#: Notices and headers that name a license.
NOTICES: dict[str, str] = {
    "MIT (notice)": "<<opt>>This <<var:what:1-3>> is<<end>> <<opt>>Released<<end>> <<opt>>Licensed<<end>> <<opt>>Distributed<<end>> under the MIT License",
    "Apache-2.0 (notice)": "Licensed under the Apache License<<opt>>,<<end>> Version 2.0",
    "Apache-2.0 (header)": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use "
        "<<var:what:1-4>> except in compliance with the License. You may obtain a copy of the "
        "License at <<opt>>http<<end>> <<opt>>https<<end>> www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed "
        "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "GPL (notice)": "<<opt>>This <<var:what:1-3>> is<<end>> licensed under the <<opt>>terms of the<<end>> GNU General Public License<<opt>>, version <<var:version:1-2>><<end>>",
    "GPL-3.0-or-later (header)": (
        "<<var:program:0-3>> is free software: you can redistribute it and/or modify it under "
        "the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version"
    ),
    "LGPL (notice)": "licensed under the <<opt>>terms of the<<end>> GNU Lesser General Public License<<opt>>, version <<var:version:1-2>><<end>>",
    "MPL-2.0 (header)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC (notice)": "Licensed under CC BY<<opt>>-NC<<end>><<opt>>-SA<<end>><<opt>>-ND<<end>> <<opt>><<var:version:2-2>><<end>>",
    "CC0 (notice)": "<<opt>>To the extent possible under law,<<end>> <<var:author:1-8>> has waived all copyright and related or neighboring rights to",
    "BSD (notice)": "<<opt>>Released<<end>> <<opt>>Licensed<<end>> under the <<opt>>2<<end>><<opt>>3<<end>><<opt>>new<<end>><<opt>>simplified<<end>> BSD <<opt>>3<<end>> <<opt>>Clause<<end>> License",
    "SPDX tag": "SPDX License Identifier <<var:id:1-6>>",
}
TEMPLATES = NOTICES | {p.stem: p.read_text(encoding="utf-8") for p in sorted(TEXTS.glob("*.txt"))}


def words_of(text: str) -> list[str]:
    """The words of a text as ``textvec`` sees them, with equal spellings made equal."""
    return [_EQUAL.get(w, w) for w in (x.decode("utf-8", "surrogatepass") for x in re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode("utf-8", "surrogatepass")))]


@dataclass
class Automaton:
    """``edges[s]``: word to next states; ``wild[s]``: next states by any word; ``free[s]``: next states without a word. State 0 starts."""

    name: str
    edges: list[dict[int, set[int]]] = field(default_factory=list)
    wild: list[set[int]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    final: int = 0
    runs: list[list[int]] = field(default_factory=list)
    signs: list[int] = field(default_factory=list)
    tail: set[int] = field(default_factory=set)

    def state(self) -> int:
        self.edges.append({})
        self.wild.append(set())
        self.free.append(set())
        return len(self.edges) - 1

    def closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def step(self, states: set[int], word: int, tail: bool = True) -> set[int]:
        """The next states; without ``tail``, replaceable words at the template's end take nothing."""
        nxt: set[int] = set()
        for s in states:
            nxt |= self.edges[s].get(word, set())
            if tail or s not in self.tail:
                nxt |= self.wild[s]
        return self.closure(nxt)

    def matches_at(self, words: list[int], start: int) -> bool:
        states = self.first
        for i in range(start, len(words)):
            states = self.step(states, words[i])
            if not states or self.final in states:
                return bool(states)
        return False

    def longest(self, words: list[int], start: int) -> int | None:
        """End of the longest match from ``start``, or None."""
        states, end = self.first, None
        for i in range(start, len(words)):
            anew = i > start and words[i] in self.begin and not self.tail.isdisjoint(states) and self.matches_at(words, i)
            states = self.step(states, words[i], not anew)
            if not states:
                break
            if self.final in states:
                end = i + 1
        return end

    def seal(self) -> None:
        self.first = self.closure({0})
        self.begin = {w for s in self.first for w in self.edges[s]}
        ends = {self.final}  # states that need no further word of the template
        while more := {s for s in range(len(self.edges)) if s not in ends and not ends.isdisjoint(self.free[s] | self.wild[s])}:
            ends |= more
        self.tail = {s for s in ends if self.wild[s] and not ends.isdisjoint(self.wild[s])}
        self.any_first = any(self.wild[s] for s in self.first)


def _hash(words: list[str]) -> list[int]:
    return word_hashes([" ".join(words)])[0].tolist()


def compile_template(name: str, markup: str) -> Automaton:
    """The automaton of a template, and the runs of words that any match must hold."""
    a = Automaton(name)
    at = a.state()
    opened: list[int] = []
    stretch: list[tuple[int, int]] = []

    def close() -> None:
        for i in range(max(1, len(stretch) - 2) if stretch else 0):
            a.runs.append([h for h, _ in stretch[i : i + 3]])
            a.signs.append(sum(n for _, n in stretch[i : i + 3]))
        stretch.clear()

    for i, piece in enumerate(_MARK.split(markup)):
        if i % 2 == 0:
            own = words_of(piece)
            for h, w in zip(_hash(own), own):
                to = a.state()
                a.edges[at].setdefault(h, set()).add(to)
                at = to
                if not opened:
                    stretch.append((h, len(w)))
        elif piece == "opt":
            close()
            opened.append(at)
        elif piece == "end":
            to = a.state()
            a.free[at].add(to)
            a.free[opened.pop()].add(to)
            at = to
        else:
            close()
            low, high = map(int, piece.rsplit(":", 1)[1].split("-"))
            ends = [at] if not low else []
            for k in range(1, high + 1):
                to = a.state()
                a.wild[at].add(to)
                at = to
                if k >= low:
                    ends.append(at)
            to = a.state()
            for e in ends:
                a.free[e].add(to)
            at = to
    close()
    if opened or not a.runs:
        raise ValueError(f"template {name!r} has an open optional region or no mandatory words")
    a.final = at
    a.seal()
    return a


def scan_words(automata: list[Automaton], words: list[int], chosen: list[int]) -> list[tuple[str, int, int]]:
    """Matches (name, first word, end) of the chosen automata."""
    out = []
    for i in chosen:
        a, at = automata[i], 0
        while at < len(words):
            if a.any_first or words[at] in a.begin:
                end = a.longest(words, at)
                if end is not None:
                    out.append((a.name, at, end))
                    at = end
                    continue
            at += 1
    return out


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where values stand in the sorted array ``known``."""
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values) if len(known) else np.empty(0, np.int64)


def scanner(templates: dict[str, str]):
    """Function of a list of texts: the matches of each."""
    automata = [compile_template(n, m) for n, m in templates.items()]
    run_hash = lambda r: int(shingles(np.array(r, dtype=np.uint64), len(r))[0])
    need: list[dict[int, np.ndarray]] = []  # of each automaton, its runs by length
    first: dict[int, dict[int, list[int]]] = {}  # by length and hash: the automata that this run is looked for
    for i, a in enumerate(automata):
        by: dict[int, set[int]] = {}
        for r in a.runs:
            by.setdefault(len(r), set()).add(run_hash(r))
        need.append({n: np.array(sorted(hs), dtype=np.uint64) for n, hs in by.items()})
        r = a.runs[max(range(len(a.runs)), key=lambda k: (len(a.runs[k]), a.signs[k]))]
        first.setdefault(len(r), {}).setdefault(run_hash(r), []).append(i)
    known = {n: np.array(sorted(hs), dtype=np.uint64) for n, hs in first.items()}
    same = {a: b for a, b in zip(_hash(sorted(_EQUAL)), _hash([_EQUAL[w] for w in sorted(_EQUAL)]))}
    odd = np.array(sorted(same), dtype=np.uint64)
    even = np.array([same[int(x)] for x in odd], dtype=np.uint64)

    def scan(texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        out: list[list[tuple[str, int, int]]] = []
        for s in batches(texts):
            words, off = word_hashes(texts[s])
            at = np.minimum(np.searchsorted(odd, words), len(odd) - 1)
            words = np.where(odd[at] == words, even[at], words)
            maybe: dict[int, set[int]] = {}
            for n, k in known.items():
                h = shingles(words, n)
                for p in _in(h, k).tolist():
                    d = int(np.searchsorted(off, p, side="right")) - 1
                    if p + n <= off[d + 1]:
                        maybe.setdefault(d, set()).update(first[n][int(h[p])])
            base = len(out)
            out.extend([] for _ in range(len(off) - 1))
            for d, some in maybe.items():
                own = words[off[d] : off[d + 1]]
                have = {n: np.unique(shingles(own, n)) for n in {n for i in some for n in need[i]}}
                chosen = [i for i in sorted(some) if all(len(have[n]) and len(_in(hs, have[n])) == len(hs) for n, hs in need[i].items())]
                if chosen:
                    out[base + d] = scan_words(automata, own.tolist(), chosen)
        return out

    return scan


_SCANNERS: dict[tuple, object] = {}


def _scanner(templates: dict[str, str]):
    """This process's scanner of these templates."""
    key = tuple(templates.items())
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = scanner(templates)
    return _SCANNERS[key]


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, start_word, end_word) of every match; words count from 0, the end is exclusive."""
    templates = TEMPLATES if templates is None else templates
    for n, m in templates.items():
        compile_template(n, m)  # errors show here, not in a task

    @F.arrow_udf("array<struct<license:string,start_word:int,end_word:int>>")
    def scan(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = _scanner(templates)
        kind = pa.list_(pa.struct([("license", pa.string()), ("start_word", pa.int32()), ("end_word", pa.int32())]))
        for part in parts:
            yield pa.array([[{"license": a, "start_word": b, "end_word": c} for a, b, c in m] for texts in slices(part) for m in run(texts)], type=kind)

    return small_batches(docs).select("doc_id", F.explode(scan("text")).alias("m")).select("doc_id", "m.license", "m.start_word", "m.end_word")
