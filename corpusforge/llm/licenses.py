"""License scans by template markup.

A template is a license or notice text with regions in markup: [[ ... ]] may be left out, {{n}} stands for up to n words of
any kind, everything else is mandatory and must agree word for word. All templates are compiled into one automaton over
word ids, made deterministic as texts are read. A text's words are found and hashed in bulk; the automaton runs only from
places where two words open some template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import _IS_ASCII_NON_ALNUM, Words, arrow_task, table
from corpusforge.llm.tokens import slices

#: Phrases whose every place counts (fixed values), with their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_OPEN = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_CLOSE = "this software is provided by {{8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"

#: License texts and notices in markup, with their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software [[" + _AS_IS + "]]"),
    ("mit", "[[this work is]] [[this software is]] [[released]] under [[the]] [[terms of the]] mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd-2-clause", _BSD_OPEN + " " + _BSD_CLOSE),
    ("bsd-3-clause", _BSD_OPEN + " [[3]] neither the name of {{10}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission [[" + _BSD_CLOSE + "]]"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("apache-2", "licensed under the apache license version 2 [[0]] [[the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{10}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied]]"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2 [[0]]"),
    ("gpl-3", "licensed under the gnu general public license version 3 [[0]]"),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license [[or at your option any later version]]"),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license [[or at your option any later version]]"),
    ("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under [[a]] [[the]] cc by nc [[4 0]] [[3 0]]"),
    ("cc-by-nc", "licensed under [[a]] [[the]] creative commons attribution noncommercial {{2}} [[international]] license"),
    ("cc-by-sa", "licensed under [[a]] [[the]] creative commons attribution sharealike {{2}} [[international]] license"),
    ("cc-by-sa", "licensed under [[a]] [[the]] cc by sa [[4 0]] [[3 0]]"),
    ("cc-by", "licensed under [[a]] [[the]] creative commons attribution [[4 0]] [[3 0]] [[international]] license"),
    ("cc0", "to the extent possible under law {{12}} has waived all copyright and related or neighboring rights"),
    ("proprietary", "all rights reserved [[{{12}}]] [[unauthorized]] copying of this file via any medium is strictly prohibited"),
]

_ITEM = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[a-z0-9]+")


class Automaton:
    """Templates as one automaton; states are sets, built as they are met."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.words: dict[str, int] = {}
        self.steps: list[dict[int, int]] = []  # word id -> state
        self.any: list[int | None] = []  # state after any word
        self.free: list[list[int]] = []  # states reached without a word
        self.accepts: dict[int, int] = {}
        starts = []
        self.longest = 0  # words that a match can have
        for n, (_, text) in enumerate(templates):
            items = _ITEM.findall(text)
            self.longest = max(self.longest, sum(int(x[2:-2]) if x[0] == "{" else x[0] not in "[]" for x in items))
            start, end, used = self._build(items, 0)
            if used != len(items):
                raise ValueError(f"brackets don't match in template {n}")
            self.accepts[end] = n
            starts.append(start)
        self.start = self._closed(starts)
        self.cache: dict[tuple[frozenset, int], frozenset] = {}
        self.accepted: dict[frozenset, list[int]] = {}
        self.openings = set()
        for a in self._words_of(self.start):
            after = self.next(self.start, a)
            if any(self.any[s] is not None for s in after) or self.done(after):
                raise ValueError("a template must open with two words")
            self.openings |= {(a, b) for b in self._words_of(after)}

    def _state(self) -> int:
        self.steps.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.steps) - 1

    def _build(self, items: list[str], i: int) -> tuple[int, int, int]:
        start = at = self._state()
        while i < len(items) and items[i] != "]]":
            if items[i] == "[[":
                inner, end, i = self._build(items, i + 1)
                if i >= len(items):
                    raise ValueError("an optional region doesn't end")
                after = self._state()
                self.free[at] += [inner, after]
                self.free[end].append(after)
                at = after
            elif items[i][0] == "{":
                after = self._state()
                self.free[at].append(after)
                for _ in range(int(items[i][2:-2])):
                    step = self._state()
                    self.any[at] = step
                    self.free[step].append(after)
                    at = step
                at = after
            else:
                after = self._state()
                self.steps[at][self.words.setdefault(items[i], len(self.words))] = after
                at = after
            i += 1
        return start, at, i

    def _closed(self, states) -> frozenset:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo += self.free[s]
        return frozenset(out)

    def _words_of(self, states: frozenset) -> set[int]:
        return {w for s in states for w in self.steps[s]}

    def next(self, states: frozenset, word: int) -> frozenset:
        key = (states, word)
        if (out := self.cache.get(key)) is None:
            to = [self.steps[s][word] for s in states if word in self.steps[s]] + [self.any[s] for s in states if self.any[s] is not None]
            out = self.cache[key] = self._closed(to)
        return out

    def done(self, states: frozenset) -> list[int]:
        if (out := self.accepted.get(states)) is None:
            out = self.accepted[states] = [self.accepts[s] for s in states if s in self.accepts]
        return out

    def matches(self, words: list[int], at: int, end: int) -> dict[int, int]:
        """Templates that accept words from `at` on, with the end of the longest match of each."""
        states, out = self.start, {}
        while at < end and states:
            states = self.next(states, words[at])
            at += 1
            for n in self.done(states):
                out[n] = at
        return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """doc_id, n_words and `found`: an array of (kind "phrase" or "template", label, first word, word after the last).

    docs needs doc_id and text; other columns aren't read. A null text is empty. Rows are scanned one by one, so repeated
    rows give equal results. Of a template's matches at one place the longest counts.
    """
    schema = "doc_id bigint, n_words bigint, found array<struct<kind: string, label: string, first: bigint, end: bigint>>"
    n_phrases = len(phrases)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(phrases + templates)
        vocabulary = list(automaton.words)
        hashes = Words(pa.array(vocabulary), separators=_IS_ASCII_NON_ALNUM).hashes()
        order = np.argsort(hashes)
        known = hashes[order]
        openings = np.array(sorted(a * len(vocabulary) + b for a, b in automaton.openings))
        for batch in batches:
            for lo, hi in slices(batch.column("text"), 2 << 20):
                part = batch.slice(lo, hi - lo)
                words = Words(part.column("text"), separators=_IS_ASCII_NON_ALNUM)
                h = words.hashes()
                near = np.minimum(np.searchsorted(known, h), len(known) - 1)
                ids = np.where(known[near] == h, order[near], -1)
                pairs = np.where((ids[:-1] >= 0) & (ids[1:] >= 0) & (words.doc[:-1] == words.doc[1:]), ids[:-1] * len(vocabulary) + ids[1:], -1) if len(ids) else ids
                found: list[list[dict]] = [[] for _ in range(len(part))]
                for i in np.flatnonzero(np.isin(pairs, openings)).tolist():
                    d = int(words.doc[i])
                    base, end = int(words.first[d]), int(words.first[d + 1])
                    run = ids[i : min(end, i + automaton.longest)].tolist()
                    hits = automaton.matches(run, 0, len(run))
                    if hits:  # words were found by hash: their bytes decide
                        wrong = [k for k in range(max(hits.values())) if run[k] >= 0 and words.data[words.start[i + k] : words.end[i + k]].tobytes() != vocabulary[run[k]].encode()]
                        if wrong:
                            run = [-1 if k in wrong else w for k, w in enumerate(run)]
                            hits = automaton.matches(run, 0, len(run))
                    for n, stop in hits.items():
                        found[d].append({"kind": "phrase" if n < n_phrases else "template", "label": automaton.labels[n], "first": i - base, "end": i - base + stop})
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "n_words", "found"],
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(arrow_task(scan), schema)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the matches in every document, null and empty texts (no words) included; score is the share of a text's words that matches cover, 0 without words."""
    scanned = scan_licenses(table(spark, sf_dir, "documents"))
    covered = "aggregate(array_sort(transform(found, m -> struct(m.first as a, m.end as b))), named_struct('n', 0L, 'to', 0L), (s, m) -> named_struct('n', s.n + greatest(0L, m.b - greatest(m.a, s.to)), 'to', greatest(s.to, m.b)), s -> s.n)"
    base = "filter(found, m -> m.kind = 'phrase')"
    return scanned.select(
        "doc_id",
        "n_words",
        F.expr(f"cast(size({base}) as bigint)").alias("n_base"),
        F.expr(f"array_min(transform({base}, m -> m.first))").alias("first_word"),
        F.expr(f"array_max(transform({base}, m -> m.first))").alias("last_word"),
        F.expr(f"array_join(array_sort(array_distinct(transform({base}, m -> m.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(transform(found, m -> m.label))), ',')").alias("labels"),
        F.coalesce(F.try_divide(F.expr(covered).cast("double"), F.col("n_words")), F.lit(0.0)).alias("score"),
    )
