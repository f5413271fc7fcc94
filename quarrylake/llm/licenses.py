"""License scans: a suffix automaton of license wording streams over the words of each text.

The automaton accepts every run of words of every template; walking a text through it gives,
at each word, the longest run that ends there and stands in some template (the matching
statistics). Maximal runs of at least ``MIN_RUN`` words are chained at all their places in a
template, in order and with bounded gaps, into covered spans of it; a template whose words are
covered to at least ``MIN_COVER`` gives its label. Words that tell the licenses of a family apart
(its versions, or clauses such as NoDerivatives) must agree: no chain passes over one in the text
or in the template. Where spans of two licenses overlap, the one with more words stays, as a
longer license holds a shorter one's clauses. Fixed phrases give base labels beside these.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Writer, rows_of, text_bytes

PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
MIN_RUN, MIN_COVER, MAX_GAP = 4, 0.7, 25
#: Words that tell the licenses of a family apart; digits are those of versions.
DIGITS = tuple("0123456789")
APART = {
    "": (),
    "version": DIGITS,
    "gnu": (*DIGITS, "lesser", "library", "affero"),
    "cc": ("nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike"),
}
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES INCLUDING BUT NOT LIMITED TO THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
    "FOR A PARTICULAR PURPOSE ARE DISCLAIMED IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT INDIRECT INCIDENTAL SPECIAL EXEMPLARY OR CONSEQUENTIAL DAMAGES INCLUDING BUT "
    "NOT LIMITED TO PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES LOSS OF USE DATA OR PROFITS OR BUSINESS INTERRUPTION HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY WHETHER IN CONTRACT STRICT LIABILITY OR "
    "TORT INCLUDING NEGLIGENCE OR OTHERWISE ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "


def _notice(name: str, version: str) -> str:
    return (
        f"you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
        f"You should have received a copy of the GNU {name} along with this program"
    )


def _gnu() -> tuple:
    """Long and short notices of the GNU licenses by version."""
    out = []
    for label, name, versions in (("gpl", "General Public License", ("2", "3")), ("lgpl", "Lesser General Public License", ("2.1", "3")), ("agpl", "Affero General Public License", ("3",))):
        for v in versions:
            own = f"{label}-{v}"
            out += [(own, _notice(name, v), "gnu"), (own, _notice(name, v).partition("This program")[0], "gnu"), (own, f"licensed under the GNU {name} version {v}", "gnu"), (own, f"under the terms of the GNU {name} version {v}", "gnu")]
    return tuple(out)


def _creative() -> tuple:
    """Notices of the Creative Commons licenses by their clauses."""
    names = {"nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
    out = []
    for own in ((), ("nc",), ("nd",), ("sa",), ("nc", "nd"), ("nc", "sa")):
        label, long = "-".join(("cc", "by", *own)), " ".join(("Attribution", *(names[x] for x in own)))
        short = " ".join(("licensed under CC BY", *own))
        out += [(label, short + " 4 0", "cc"), (label, short, "cc"), (label, f"licensed under a Creative Commons {long} 4.0 International License", "cc"), (label, f"licensed under the Creative Commons {long} License", "cc")]
    return tuple(out)


#: (label, wording, family): whole licenses where they are short, else their notices.
TEMPLATES = (
    ("mit", "released under the MIT License", ""),
    ("mit", "licensed under the MIT License", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ""),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "version"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License", "version"),
    *_gnu(),
    ("bsd-2", _TWO + _DISCLAIMER, ""),
    ("bsd-2", _TWO, ""),
    ("bsd-3", _TWO + _THIRD + _DISCLAIMER, ""),
    ("bsd-3", _TWO + _THIRD, ""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE", ""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ""),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software", ""),
    ("boost-1", "Distributed under the Boost Software License, Version 1.0", "version"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "version"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "version"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", ""),
    ("unlicense", "This is free and unencumbered software released into the public domain", ""),
    *_creative(),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ""),
)
#: Lower-cases A-Z and turns every other ASCII sign that is no letter or digit into a space.
_FOLD = bytes(x if chr(x) in "0123456789abcdefghijklmnopqrstuvwxyz" or x > 127 else x + 32 if 65 <= x <= 90 else 32 for x in range(256))


class Automaton:
    """Generalised suffix automaton of word sequences.

    ``ends[s]`` gives, for each template that holds the runs of state ``s``, the positions of
    the last word of all their places.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for t, words in enumerate(sequences):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].setdefault(t, []).append(at)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s]:
                for t, at in self.ends[s].items():
                    self.ends[self.link[s]].setdefault(t, []).extend(at)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def matches(self, ids: list[int], offset: int, least: int) -> list[tuple[int, int, dict[int, list[int]]]]:
        """Maximal runs (start, end, ends) of at least ``least`` words in ``ids``."""
        out, state, length = [], 0, 0
        for at, w in enumerate(ids):
            step = self.next[state].get(w)
            if step is None and length >= least:
                out.append((offset + at - length, offset + at, self.ends[state]))
            while step is None and state:
                state = self.link[state]
                length = self.length[state]
                step = self.next[state].get(w)
            if step is not None:
                state, length = step, length + 1
        if length >= least:
            out.append((offset + len(ids) - length, offset + len(ids), self.ends[state]))
        return out


def _passed(marks: list[bool]) -> list[int]:
    """How many marks stand in front of each place."""
    return [0, *itertools.accumulate(map(int, marks))]


def chains(runs: list[tuple[int, int, int]], text: list[int], template: list[int]) -> list[tuple[int, int, int]]:
    """``(covered, start, end)`` of the best chain to each run that may end one.

    ``runs`` are (start, end, place in the template), sorted. A chain goes on in text and template
    over at most MAX_GAP words of text; no word that tells licenses apart (``text`` and
    ``template`` count them up to each place) is passed over in the text, nor in the template,
    its front and its back included.
    """
    size = len(template) - 1
    chain: list[tuple[int, int, int, int]] = []  # (end in text, end in template, covered or -1, start)
    out = []
    for start, end, at in runs:
        n = end - start
        best, first = (n, start) if not template[at] else (-1, start)
        for k in range(len(chain) - 1, -1, -1):
            until, stop, covered, begun = chain[k]
            if until < start - MAX_GAP:  # runs are maximal, so their ends rise with their starts
                break
            if covered > 0 and until <= start and stop <= at and covered + n > best and text[until] == text[start] and template[stop] == template[at]:
                best, first = covered + n, begun
        chain.append((end, at + n, best, first))
        if best > 0 and template[at + n] == template[size]:
            out.append((best, first, end))
    return out


class Scanner:
    """Words of the templates, their automaton, and the phrases; built once a worker."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _, _ in templates]
        self.vocab: dict[bytes, int] = {}
        words = [text.encode().translate(_FOLD).split() for _, text, _ in templates]
        seqs = [[self.vocab.setdefault(w, len(self.vocab)) for w in own] for own in words]
        self.sizes = [len(s) for s in seqs]
        self.apart = [frozenset(x.encode() for x in APART[family]) for _, _, family in templates]
        self.passed = [_passed([w in apart for w in own]) for own, apart in zip(words, self.apart)]
        self.automaton = Automaton(seqs)
        self.phrases: dict[int, list[tuple[list[int], str]]] = {}
        for text, label in phrases:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in text.encode().split()]
            self.phrases.setdefault(ids[0], []).append((ids, label))

    def scan(self, data: bytes) -> tuple:
        """(n_words, n_base, first, last, base labels, labels, score, covered words) of a text."""
        words = data.translate(_FOLD).split()
        known = list(map(self.vocab.get, words))
        ids = np.array([-1 if k is None else k for k in known], np.int64) if any(k is not None for k in known) else None
        places, base, found = [], set(), []
        if ids is not None:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
            a, b = edge[::2], edge[1::2]
            for s, e in zip(a[b - a >= 3].tolist(), b[b - a >= 3].tolist()):
                own = known[s:e]
                for at, w in enumerate(own):
                    for ids_, label in self.phrases.get(w, ()):
                        if own[at : at + len(ids_)] == ids_:
                            places.append(s + at)
                            base.add(label)
                if e - s >= MIN_RUN:
                    found += self.automaton.matches(own, s, MIN_RUN)
        score, covered, method = self._cover(found, words) if found else (0.0, 0, set())
        labels = sorted(base | method)
        if base:
            score = 1.0
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score, covered

    def _cover(self, found: list, words: list[bytes]) -> tuple[float, int, set[str]]:
        """Best covered share of a template, its words, and labels with enough of it."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, ends in found:
            for t, places in ends.items():
                by.setdefault(t, []).extend((start, end, last + 1 - (end - start)) for last in places)
        counted: dict[frozenset, list[int]] = {}
        best, most, spans = 0.0, 0, []
        for t, runs in by.items():
            apart = self.apart[t]
            if apart not in counted:
                counted[apart] = _passed([w in apart for w in words])
            taken: list[tuple[int, int]] = []
            for covered, start, end in sorted(chains(sorted(runs), counted[apart], self.passed[t]), reverse=True):
                # A clause may follow at once, as in "CC BY" and "NC".
                if end < len(words) and words[end] in apart and not words[end].isdigit():
                    continue
                share = covered / self.sizes[t]
                if share > best or share == best and covered > most:
                    best, most = share, covered
                if share >= MIN_COVER and all(end <= a or b <= start for a, b in taken):
                    taken.append((start, end))
                    spans.append((covered, start, end, self.labels[t]))
        labels: list[tuple[int, int, str]] = []
        for _, start, end, label in sorted(spans, key=lambda x: (-x[0], x[1], x[3])):
            if not any(x != label and 2 * (min(end, b) - max(start, a)) >= end - start for a, b, x in labels):
                labels.append((start, end, label))
        return min(best, 1.0), most, {x for _, _, x in labels}


@functools.lru_cache(maxsize=4)
def scanner(templates=TEMPLATES, phrases=PHRASES) -> Scanner:
    return Scanner(templates, phrases)


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_covered", pa.int64())]
)
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_covered long"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """License labels of every row of ``docs(doc_id, text)``; one scan, no shuffle.

    ``score`` is 1 where a base phrase stands, else the best covered share of a template, and
    ``n_covered`` its covered words. A null or empty text has no words, no labels (empty
    strings) and score 0; a very long text is walked whole; repeated rows come back repeated; a
    null ``doc_id`` stays null; an empty table gives no rows; other columns are ignored, whatever
    their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, s = Writer(_OUT), scanner(templates, phrases)
        for doc, data in rows_of(batches, "doc_id", "data"):
            if out.add(doc, *s.scan(data)):
                yield out.flush()
        if len(out):
            yield out.flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data")).mapInArrow(run, SCHEMA)
