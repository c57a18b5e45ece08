"""License scan: a generalised suffix automaton of licence words, matching statistics, chained matches.

Every licence phrase and notice is one template.  Texts stream through the automaton word by word;
after each word the state gives the longest run of words ending there that stands in any template
(the matching statistics).  A phrase stands at a place exactly when its own state lies on the suffix
path of that state, which yields the base places; long matches are chained in text and template
order, each with its best predecessor, into covered template spans, which yield the labels and score.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .textarrays import ALNUM, LOWER, slices, span_array, stretches, words

# Base phrases with their labels, and passages of public licence notices.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = {
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "apache-2": "licensed under the apache license version 2 0",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
}
#: Words of a match that counts for a chain, and words of text a chain may skip between matches.
MIN_MATCH, MAX_GAP = 4, 12
#: A notice labels a text when a chain covers this share of its words.
COVERAGE = 0.6


class SuffixAutomaton:
    """The smallest automaton of all runs of words of several templates."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (template, words up to the end of the run)
        for k, template in enumerate(templates):
            last = 0
            for n, word in enumerate(template):
                last = self._extend(last, word)
                self.ends[last].add((k, n + 1))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        copy = self._new(self.length[at] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # the run already stands in an earlier template
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        state, at = self._new(self.length[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[state] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return state

    def statistics(self, stream: list[int]) -> list[tuple[int, int]]:
        """(state, length) after each word: the longest run ending there that a template holds."""
        out, state, length = [], 0, 0
        for word in stream:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if (to := self.next[state].get(word)) is None:
                length = 0
            else:
                state, length = to, length + 1
            out.append((state, length))
        return out


def chains(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, words covered) of the best chain that ends with each match, by ends.

    Matches are (start, end, template start, template end).  A chain goes on in text and template alike;
    a word counts once in each.  Only matches whose end lies near can go before, so a match looks at few.
    """
    found, out, first = sorted(found, key=lambda m: (m[1], m[0], m[2])), [], 0
    longest = max(end - start for start, end, _, _ in found)
    for start, end, t_start, t_end in found:
        while found[first][1] < end - longest - MAX_GAP:
            first += 1
        chain = (start, end, end - start)
        for (_, end_, _, t_end_), (start_, _, covered) in zip(found[first : len(out)], out[first:], strict=True):
            if end_ < end and t_end_ < t_end and start - end_ <= MAX_GAP:
                covered += min(t_end - max(t_start, t_end_), end - max(start, end_))
                if (covered, start_) > (chain[2], chain[0]):
                    chain = (start_, end, covered)
        out.append(chain)
    return out


class Licences:
    """The automaton with what its states say about phrases, and the words it knows."""

    def __init__(self):
        texts = [*PHRASES, *NOTICES.values()]
        self.labels = [*PHRASES.values(), *NOTICES]
        vocabulary = sorted({w for t in texts for w in t.split()})
        number = {w: k for k, w in enumerate(vocabulary)}
        self.templates = [[number[w] for w in t.split()] for t in texts]
        self.automaton = SuffixAutomaton(self.templates)
        self.vocabulary = pa.array([w.encode() for w in vocabulary], pa.large_binary())
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.automaton.next]  # (words, phrase) by state
        for k in range(len(PHRASES)):
            home = self.automaton.statistics(self.templates[k])[-1][0]
            for state in range(len(self.automaton.next)):
                at = state
                while at > 0 and at != home:
                    at = self.automaton.link[at]
                if at == home:
                    self.phrases[state].append((len(self.templates[k]), k))

    def known(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words that stand in a template, their numbers, and the words before each text."""
        places, numbers, bounds, n = [], [], np.zeros(len(offsets), np.int64), 0
        for a, b in stretches(data, ALNUM) if len(offsets) == 2 else [(0, len(data))]:
            own = LOWER[data[a:b]]
            starts, ends, own_bounds = words(own, np.clip(offsets - a, 0, b - a), ALNUM)
            number = pc.fill_null(pc.index_in(span_array(own, starts, ends), value_set=self.vocabulary), -1).to_numpy()
            hit = np.flatnonzero(number >= 0)
            places.append(n + hit)
            numbers.append(number[hit])
            bounds[1:] = n + own_bounds[1:]
            n += len(starts)
        return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int32), *numbers]), bounds

    def scan(self, places: np.ndarray, numbers: np.ndarray) -> tuple[list[tuple[int, int]], dict[int, float], list[tuple[str, int, int]]]:
        """(start, phrase) of base places, best coverage by template, and labelled (label, start, end) spans."""
        base, matches = [], {}
        cuts = np.flatnonzero(np.diff(places) != 1) + 1
        for run, own in zip(np.split(places, cuts), np.split(numbers, cuts), strict=True):
            if len(run) < 2:
                continue
            first, stats = int(run[0]), self.automaton.statistics(own.tolist())
            for n, (state, length) in enumerate(stats):
                for size, phrase in self.phrases[state]:
                    if size <= length:
                        base.append((first + n + 1 - size, phrase))
                last = n + 1 == len(stats) or stats[n + 1][1] <= length
                if last and length >= MIN_MATCH:
                    for template, end in self.automaton.ends[state]:
                        matches.setdefault(template, []).append((first + n + 1 - length, first + n + 1, end - length, end))
        best, spans = {}, []
        for template, found in matches.items():
            size, own = len(self.templates[template]), []
            for start, end, covered in chains(found):
                share = covered / size
                best[template] = max(best.get(template, 0.0), share)
                if share >= COVERAGE and template >= len(PHRASES):
                    last = own[-1] if own else (0, -1, 0)
                    if start == last[0] or (start >= last[0] and end <= last[1]) or (start <= last[0] and end >= last[1] >= 0):  # the same place
                        if covered >= last[2]:
                            own[-1:] = [(start, end, covered)]
                    else:
                        own.append((start, end, covered))
            spans += [(self.labels[template], start, end) for start, end, _ in own]
        return base, best, spans


@cache
def licences() -> Licences:
    return Licences()


def _scan(batch: pa.RecordBatch) -> dict:
    found = licences()
    out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
    for lo, hi, data, offsets in slices(batch.column("text")):
        places, numbers, bounds = found.known(data, offsets)
        cuts = np.searchsorted(places, bounds)
        for k in range(hi - lo):
            a, b = cuts[k], cuts[k + 1]
            base, best, spans = found.scan(places[a:b] - bounds[k], numbers[a:b]) if b - a > 1 else ([], {}, [])
            at = [s for s, _ in base]
            base_labels = {found.labels[p] for _, p in base}
            labels = base_labels | {s[0] for s in spans}
            spans = sorted(spans + [(found.labels[p], s, s + len(found.templates[p])) for s, p in base], key=lambda s: (s[1], s[2], s[0]))
            row = (int(bounds[k + 1] - bounds[k]), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1.0 if base else min(1.0, max(best.values(), default=0.0)), [dict(zip(("label", "first_word", "end_word"), s, strict=True)) for s in spans])
            for key, value in zip(out, row, strict=True):
                out[key].append(value)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))]
    return {"id": batch.column("id")} | {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)}


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: words, base phrase places, labels, score and the labelled spans (in words).

    Map-only: one pass, no shuffle.  A null or empty text has no words, no labels and score 0;
    repeated rows give equal rows; columns other than the two named are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
        _scan,
        f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long>>",
    )
