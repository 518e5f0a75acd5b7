"""Operator 12: licence texts and notices found by diagonal voting.

Every run of k words of a text (k is 3, and 2 for phrases of two words) has a hash, and so has every run of a template. A Spark join
brings the places of equal hashes together. Place in the text less place in the template names a diagonal: an unedited copy puts all
its votes on one, and words put in or left out move the rest to one near by. Votes are counted by diagonal, those of neighbouring
diagonals added up, the strongest of a neighbourhood kept, and its stretch of the text compared with the template word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import fresh, key_filter, passes, staged, table

#: Words of a run, and of one where a template has only two.
RUN, SHORT_RUN = 3, 2
#: Diagonals that far apart vote together; the share of a template's runs that must vote; the share of its words that must be found in order.
NEAR, VOTES, ALIKE = 8, 0.25, 0.75
#: Runs of templates that may be broadcast; beyond that they are joined by a shuffle.
_SENT = 500_000
_PIECE = 1 << 20


@dataclass(frozen=True)
class Template:
    """A text to look for. ``exact`` phrases count only word for word, and every place counts; ``base`` ones are counted apart."""

    label: str
    text: str
    exact: bool = False
    base: bool = False

    @property
    def words(self) -> list[bytes]:
        return words_of(self.text)


# Phrases whose places are counted, and their labels.
BASE = (
    Template("gpl", "gnu general public license", True, True),
    Template("apache", "apache license", True, True),
    Template("cc-by", "cc by", True, True),
    Template("mit", "mit license", True, True),
)

# Further phrases that name a licence.
PHRASES = (
    Template("lgpl", "gnu lesser general public license", True),
    Template("agpl", "gnu affero general public license", True),
    Template("mpl", "mozilla public license", True),
    Template("epl", "eclipse public license", True),
    Template("bsd", "bsd license", True),
    Template("isc", "isc license", True),
    Template("cc-by-sa", "cc by sa", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("cc-by-nd", "cc by nd", True),
    Template("cc0", "cc0 1 0", True),
    Template("all-rights-reserved", "all rights reserved", True),
)

# Wording of public licences and of the notices they ask for.
NOTICES = (
    Template("mit", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software."""),
    Template("apache", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License."""),
    Template("gpl", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    Template("lgpl", """
        This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
        version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    Template("agpl", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    Template("bsd", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    Template("isc", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    Template("mpl", """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at"""),
    Template("unlicense", """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means."""),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
)
TEMPLATES = (*BASE, *PHRASES, *NOTICES)

# A word is a run of ASCII letters and digits and of anything beyond ASCII (``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once folded).
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_BASE, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())  # bytes fold A-Z alone


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def _bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of bytes begin and end."""
    edges = np.flatnonzero(np.diff(_IN_WORD[data], prepend=False, append=False))
    return edges[::2], edges[1::2]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash; long input in pieces that end between words."""
    starts, hashes, begin = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    whole = _FOLDED[np.frombuffer(raw, np.uint8)]
    while begin < len(whole):
        end = min(begin + _PIECE, len(whole))
        while end < len(whole) and _IN_WORD[whole[end]]:
            gap = np.flatnonzero(~_IN_WORD[whole[end : end + 4096]])
            end = end + int(gap[0]) if len(gap) else min(end + 4096, len(whole))
        data = whole[begin:end]
        first, stop = _bounds(data)
        if len(first):
            length = stop - first
            ahead = np.cumsum(length) - length
            place = np.arange(int(length.sum())) - np.repeat(ahead, length)  # within its word
            power = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
            value = (data[np.repeat(first, length) + place].astype(np.uint64) + np.uint64(1)) * power[place]
            starts.append(first + begin)
            hashes.append(_mixed(np.add.reduceat(value, ahead) + length.astype(np.uint64)))
        begin = end
    return np.concatenate(starts), np.concatenate(hashes)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` words, from hashes of the words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = _mixed(total + words[j : j + n]) * _BASE
    return total.view(np.int64)


def _run_of(template: Template) -> int:
    return RUN if len(template.words) >= RUN else SHORT_RUN


def template_runs(templates: Sequence[Template]) -> list[tuple[int, int, int, int, bool]]:
    """(run, template, place, votes needed, exact) of all templates."""
    out = []
    for number, template in enumerate(templates):
        k = _run_of(template)
        if len(template.words) < k:
            raise ValueError(f"a template needs {SHORT_RUN} words: {template.text!r}")
        runs = run_hashes(word_hashes(template.text.encode())[1], k)
        need = len(runs) if template.exact else max(1, int(len(runs) * VOTES))
        out += [(int(run), number, place, need, template.exact) for place, run in enumerate(runs)]
    return out


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """First row and texts, as many as fit a piece; a null is empty."""
    first, held, size = 0, [], 0
    for i, value in enumerate(column):
        held.append((value.as_py() or "").encode())
        size += len(held[-1])
        if size >= _PIECE or i == len(column) - 1:
            yield first, held
            first, held, size = i + 1, [], 0


def _run_places(docs: DataFrame, text: str, keys: list[str], runs: Sequence[int]) -> DataFrame:
    """(keys, pos, run): runs of all texts by their first word. Only those that may be a template's leave the task."""
    bits = np.zeros(1 << 20, bool)
    bits[np.array(runs, np.int64) & ((1 << 20) - 1)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in _chunks(batch.column(2)):
                starts, hashes = word_hashes(b"\n".join(held))
                edges = np.concatenate([[0], np.cumsum([len(x) + 1 for x in held])])
                row = np.searchsorted(edges, starts, "right") - 1
                ahead = np.searchsorted(starts, edges)
                for k in (SHORT_RUN, RUN):
                    found = run_hashes(hashes, k)
                    at = np.flatnonzero(bits[found & ((1 << 20) - 1)])
                    at = at[row[at] == row[at + k - 1]]
                    rows = pa.array(first + row[at], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - ahead[row[at]], pa.int64()), pa.array(found[at], pa.int64())],
                        names=[*keys, "pos", "run"])

    return docs.select(*keys, text).mapInArrow(run, f"{keys[0]} long, {keys[1]} long, pos long, run long")


def candidates(places: DataFrame, templates: Sequence[Template], keys: list[str]) -> DataFrame:
    """(keys, template, diagonal) worth comparing. Copies of a text share their keys, and so their votes count once."""
    spark = places.sparkSession
    rows = template_runs(templates)
    known = spark.createDataFrame(rows, "run long, template int, place long, need long, exact boolean")
    known = F.broadcast(known) if len(rows) <= _SENT else known
    hits = places.join(known, "run").select(*keys, "template", "need", "exact", (F.col("pos") - F.col("place")).alias("diagonal"), "place").distinct()
    votes = hits.groupBy(*keys, "template", "need", "exact", "diagonal").agg(F.count(F.lit(1)).alias("votes"))
    near = Window.partitionBy(*keys, "template").orderBy("diagonal").rangeBetween(-NEAR, NEAR)
    summed = votes.withColumn("support", F.when(F.col("exact"), F.col("votes")).otherwise(F.sum("votes").over(near))).where("support >= need")
    strength = F.struct("support", "votes", -F.col("diagonal"))
    peaks = summed.withColumn("peak", F.col("exact") | (strength == F.max(strength).over(near)))
    return peaks.where("peak").select(*keys, "template", "diagonal")


def in_order(template: list[bytes], words: list[bytes]) -> int:
    """The most words of the template found in ``words`` in their order: longest common subsequence, a bit per word of the template."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(template):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(template)) - 1
    rest = full
    for w in words:
        met = rest & places.get(w, 0)
        rest = ((rest + met) | (rest - met)) & full
    return len(template) - rest.bit_count()


def verified(words: list[bytes], found: list[tuple[int, int]], templates: Sequence[Template], cut: Sequence[list[bytes]]) -> list[tuple[int, int, int, float]]:
    """(template, first word, number of words, likeness) of the candidates that hold. Of inexact ones that overlap, the one most alike
    stays (then the longer, then the first)."""
    exact, alike = [], []
    for number, diagonal in sorted(found):
        own, n = cut[number], len(cut[number])
        if templates[number].exact:
            if diagonal >= 0 and words[diagonal : diagonal + n] == own:
                exact.append((number, diagonal, n, 1.0))
            continue
        common = in_order(own, words[max(0, diagonal - NEAR) : max(0, diagonal + n + NEAR)])
        if common >= ALIKE * n:
            first = max(0, diagonal)
            alike.append((number, first, min(n + diagonal, len(words)) - first, common / n))
    kept: list[tuple[int, int, int, float]] = []
    taken: list[tuple[int, int]] = []
    for span in sorted(alike, key=lambda s: (-s[3], -s[2], s[1], s[0])):
        if all(span[1] >= stop or span[1] + span[2] <= start for start, stop in taken):
            kept.append(span)
            taken.append((span[1], span[1] + span[2]))
    return sorted(exact + kept, key=lambda s: (s[1], s[0]))


SPANS = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("likeness", T.DoubleType())]))
_RESULT = [
    T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", SPANS)]


def _result(text: str | None, found: list[tuple[int, int]], templates: Sequence[Template], cut: Sequence[list[bytes]]) -> tuple:
    spans = verified(words_of(text), found, templates, cut) if found and text else []
    base = [s for s in spans if templates[s[0]].base]
    named = lambda some: ",".join(sorted({templates[s[0]].label for s in some}))
    listed = [{"label": templates[s[0]].label, "first_word": s[1], "n_words": s[2], "likeness": s[3]} for s in spans]
    return (
        len(base), min((s[1] for s in base), default=None), max((s[1] for s in base), default=None), named(base), named(spans),
        max((s[3] for s in spans), default=0.0), listed)


def scanned(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words``, places of base phrases (``n_base``, ``first_word``, ``last_word``, ``base_labels``), ``labels``
    of all templates found, ``score`` (the likeness of the best one, 0 without any) and ``spans``, in place of columns of these names.

    A null text is empty: no words, no labels. Equal texts, in rows of whatever ids, are worked on once and give equal results. An inexact
    template is found with up to a quarter of its words missing or changed and up to ``NEAR`` words put in or left out in a row; more in one
    place parts it into two. Only texts with candidates are shuffled: a fixed-size filter of their keys lets the rest pass by."""
    result = ["n_words", *[f.name for f in _RESULT]]
    docs = docs.drop(*[c for c in result if c != text])
    k1 = fresh("key_a", docs.columns)
    k2 = fresh("key_b", docs.columns)
    s1, s2, wanted, held = fresh("of_a", docs.columns), fresh("of_b", docs.columns), fresh("found", docs.columns), fresh("held", docs.columns)
    keyed = docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit(len(templates)), text)})
    rows = template_runs(templates)
    places = _run_places(keyed, text, [k1, k2], sorted({r[0] for r in rows}))
    found = staged(
        candidates(places, templates, [k1, k2]).groupBy(F.col(k1).alias(s1), F.col(k2).alias(s2))
        .agg(F.collect_list(F.struct("template", "diagonal")).alias(wanted)), "license-candidates")
    bits = key_filter(found, s1)

    names = keyed.columns
    kept = [f for f in keyed.schema.fields if f.name != text]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(text))
            counts = []
            for _, part in _chunks(column):
                starts, _ = _bounds(_FOLDED[np.frombuffer(b"\n".join(part), np.uint8)])
                edges = np.concatenate([[0], np.cumsum([len(x) + 1 for x in part])])
                counts.append(np.diff(np.searchsorted(starts, edges)))
            near = passes(bits, batch.column(names.index(k1)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(f.name)) for f in kept]
                + [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pc.if_else(pa.array(near), column, pa.scalar(None, column.type))],
                names=[f.name for f in kept] + ["n_words", held])

    base = keyed.mapInArrow(counted, T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField(held, T.StringType())]))
    joined = base.join(found, (F.col(k1) == F.col(s1)) & (F.col(k2) == F.col(s2)), "left").drop(k1, k2, s1, s2)
    out = [f for f in joined.schema.fields if f.name not in (held, wanted)]
    at = [joined.columns.index(f.name) for f in out]
    text_at, found_at = joined.columns.index(held), joined.columns.index(wanted)
    cut = [t.words for t in templates]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in _RESULT]
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                lists = [[(e["template"], e["diagonal"]) for e in x or ()] for x in batch.column(found_at).to_pylist()]
                made = [_result(batch.column(text_at)[i].as_py() if some else None, some, templates, cut) for i, some in enumerate(lists)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in at] + [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)],
                    names=[f.name for f in [*out, *_RESULT]])

    return joined.mapInArrow(judged, T.StructType([*out, *_RESULT]))


def op12_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or quoted in every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scanned(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
