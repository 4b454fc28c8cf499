"""License scans by template markup.

A template is mandatory wording with marked regions: ``[[...]]`` may be left out, ``{{n}}`` stands for up to n words of any kind.  It
compiles to a token automaton, and a passage matches if the automaton accepts it: every mandatory word in place, exactly.  Texts are
tokenised once per batch; automata run only from places where a template's first two words stand, found on word hashes, so a text
without them costs no more than its tokens.  The job is one map over the documents without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .common import table

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license wording, with markup.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice [[(including the next
        paragraph)]] shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND {{12}}
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. [[3.]] Neither the name of {{12}} nor
        the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
        permission.""",
    "apache-2.0": "Licensed under the Apache License, Version 2.0[[ (the \"License\")]]",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at {{12}} Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl-notice": """This program is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation[[,]] either version {{1}} of the License[[, or (at your option) any later version]]""",
    "agpl-notice": """This program is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation[[,]] either version {{1}} of the License[[, or (at your option) any later version]]""",
    "lgpl-notice": """This [[library]][[program]] is free software[[;]] you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation[[;]] either version {{2}} of the License[[, or (at your option) any later
        version]]""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at""",
    "epl-2.0-notice": """This program and the accompanying materials are made available under the terms of the Eclipse Public License [[v. ]]2.0 which
        [[accompanies this distribution, and ]]is available at""",
    "bsl-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
        prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
        following""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will {{8}} be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: [[1.]] The origin of this software must
        not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment
        [[(see the following)]] in the product documentation would be appreciated but is not required. [[2.]] Altered source versions must be
        plainly marked as such, and must not be misrepresented as being the original software. [[3.]] This notice may not be removed or altered
        from any source distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
        by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
        interest in the software to the public domain.""",
    "gpl-version": "GNU [[Lesser ]][[Affero ]]General Public License[[,]] version {{2}}",
    "mit-short": "[[is ]]licensed under the MIT License",
    "mit-released": "Released under the MIT License",
    "cc-by-nc": "Licensed under [[a ]][[the ]][[Creative Commons ]]CC BY-NC [[{{1}} ]]4.0",
    "cc-by-sa": "Licensed under [[a ]][[the ]][[Creative Commons ]]CC BY-SA [[{{1}} ]]4.0",
    "cc-by": "Licensed under [[a ]][[the ]][[Creative Commons ]]CC BY 4.0",
    "cc0": "Licensed under [[a ]][[the ]][[Creative Commons ]]CC0 [[1.0]]",
    "all-rights-reserved": "Copyright {{8}} All rights reserved",
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)\}\}")


def fold(text: str) -> str:
    """A-Z in lower case; other letters stay."""
    return text.translate({c: c + 32 for c in range(0x41, 0x5B)})


@dataclass
class Automaton:
    """States 0..n; words[s] leads from s to s + 1, skips[s] are states reached from s freely, and gaps stay for any word."""

    label: str
    words: list[str | None]
    skips: list[list[int]]
    mandatory: int

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def accept(self, tokens: list[str]) -> int:
        """Tokens of the longest accepted start of ``tokens``; -1 if none is."""
        states, longest, end = self.closure({0}), -1, len(self.words)
        for i, token in enumerate(tokens):
            if end in states:
                longest = i
            states = self.closure({s + 1 for s in states if s < end and self.words[s] in (None, token)})
            if not states:
                return longest
        return len(tokens) if end in states else longest

    def openings(self) -> set[tuple[str, str | None]]:
        """First words with the words that may follow them (None: any or none)."""
        end, out = len(self.words), set()
        for s in self.closure({0}):
            if s < end and self.words[s] is not None:
                after = self.closure({s + 1})
                out |= {(self.words[s], None)} if end in after or any(self.words[t] is None for t in after if t < end) else {(self.words[s], self.words[t]) for t in after if t < end}
        return out


def compile_template(label: str, template: str) -> Automaton:
    """Word, optional and gap regions as states; a template must open with a word."""
    words: list[str | None] = []
    skips: list[list[int]] = [[]]
    opened: list[int] = []
    mandatory = at = 0

    def add(word: str | None) -> None:
        words.append(word)
        skips.append([])

    for m in [*_MARK.finditer(template), None]:
        plain = _WORD.findall(fold(template[at : m.start() if m else len(template)]))
        for w in plain:
            add(w)
        mandatory += 0 if opened else len(plain)
        if m is None:
            break
        at = m.end()
        if m[0] == "[[":
            opened.append(len(words))
        elif m[0] == "]]":
            skips[opened.pop()].append(len(words))
        else:
            first = len(words)
            for _ in range(int(m[1])):
                add(None)
            for s in range(first, len(words)):
                skips[s].append(len(words))
    if opened:
        raise ValueError(f"{label}: an optional region is not closed")
    out = Automaton(label, words, skips, mandatory)
    if not out.openings() or any(words[s] is None for s in out.closure({0}) if s < len(words)):
        raise ValueError(f"{label}: a template must open with a word")
    return out


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(tx.word_hashes(data, tx.Words(np.array([0]), np.array([len(data)]), np.array([0, 1])))[0])


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = [compile_template(k, v) for k, v in templates.items()]
        self.phrases = [(np.array([_hash(w) for w in k.split()], np.uint64), v) for k, v in phrases.items()]
        self.opening = [[(np.uint64(_hash(a)), None if b is None else np.uint64(_hash(b))) for a, b in x.openings()] for x in self.automata]
        self.longest = max((len(x.words) for x in self.automata), default=0) + 1

    def phrase_places(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all phrases, and which phrase."""
        places, which = [], []
        for k, (phrase, _) in enumerate(self.phrases):
            n = len(hashes) - len(phrase) + 1
            if n <= 0:
                continue
            hit = doc[:n] == doc[len(phrase) - 1 :]
            for j, h in enumerate(phrase):
                hit = hit & (hashes[j : j + n] == h)
            at = np.flatnonzero(hit)
            places.append(at)
            which.append(np.full(len(at), k))
        return (np.concatenate(places), np.concatenate(which)) if places else (np.zeros(0, np.int64),) * 2

    def template_matches(self, hashes: np.ndarray, bounds: np.ndarray, doc: np.ndarray, token: Callable[[int], str]) -> list[tuple[int, str, int, int]]:
        """doc, label, first word and end of accepted passages; per template they don't overlap."""
        out = []
        after = np.concatenate([hashes[1:], np.zeros(1, np.uint64)]) if len(hashes) else hashes
        for automaton, openings in zip(self.automata, self.opening, strict=True):
            hit = np.zeros(len(hashes), bool)
            for a, b in openings:
                hit |= (hashes == a) if b is None else (hashes == a) & (after == b)
            free = 0
            for at in np.flatnonzero(hit).tolist():
                if at < free:
                    continue
                last = int(bounds[doc[at] + 1])
                length = automaton.accept([token(i) for i in range(at, min(last, at + len(automaton.words)))])
                if length > 0:
                    out.append((int(doc[at]), automaton.label, at, at + length))
                    free = at + length
        return out


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(templates: dict[str, str], phrases: dict[str, str]) -> Scanner:
    key = (*templates.items(), *phrases.items())
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(templates, phrases)
    return _SCANNERS[key]


_MATCH = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))


def _scan(templates: dict[str, str], phrases: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates, phrases)
        for batch in batches:
            for piece in tx.pieces(batch.column(1)):
                data = piece.data = tx.LOWER[piece.data]
                w = tx.words(piece, tx.LETTER_DIGIT)
                hashes = tx.word_hashes(data, w)
                n = piece.last - piece.first
                doc = np.repeat(np.arange(n), w.counts())

                def token(i: int, data: np.ndarray = data, w: tx.Words = w) -> str:
                    return data[w.starts[i] : w.ends[i]].tobytes().decode()

                places, which = scanner.phrase_places(hashes, doc)
                own = doc[places]
                first, last, labels = [None] * n, [None] * n, [set() for _ in range(n)]
                for p, k, d in zip(places.tolist(), which.tolist(), own.tolist(), strict=True):
                    at = p - int(w.bounds[d])
                    first[d] = at if first[d] is None else min(first[d], at)
                    last[d] = at if last[d] is None else max(last[d], at)
                    labels[d].add(scanner.phrases[k][1])
                matches: list[list[dict]] = [[] for _ in range(n)]
                for d, label, a, b in scanner.template_matches(hashes, w.bounds, doc, token):
                    matches[d].append({"label": label, "first": a - int(w.bounds[d]), "end": b - int(w.bounds[d])})
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(piece.first, n),
                    "n_words": pa.array(w.counts(), pa.int64()),
                    "n_base": pa.array(np.bincount(own, minlength=n), pa.int64()),
                    "first_word": pa.array(first, pa.int64()),
                    "last_word": pa.array(last, pa.int64()),
                    "base_labels": pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                    "matches": pa.array(matches, _MATCH),
                })

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: id, n_words, n_base (places of phrases), first_word, last_word, base_labels, matches (label, first word, end) and score.

    The score is 1 where a template matches, 0.5 where only a phrase stands, else 0.  Null text counts as empty: no words, nulls for the
    places, no labels.  Repeated rows are judged alike; an empty table gives an empty result; a very long text is read whole, in a piece
    of its own.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("id", own.schema["id"].dataType)])
    for name, kind in (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "array<string>"), ("matches", "array<struct<label:string,first:long,end:long>>")):
        schema.add(name, T.DataType.fromDDL(kind))
    out = own.mapInArrow(_scan(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases), schema)
    score = F.when(F.size("matches") > 0, 1.0).when(F.col("n_base") > 0, 0.5).otherwise(0.0)
    return out.withColumn("score", score).withColumnRenamed("id", id_col)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("matches", lambda m: m["label"]))))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score")
