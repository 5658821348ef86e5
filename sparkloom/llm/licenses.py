"""License scans by conditional compression.

A candidate block is a run of words of one paragraph, near a word that names a licence (a cue), that
differs from a template in at most a quarter of the template's words, wherever lines and sentences
end; it is found by alignment. Candidates are ranked by the bytes that the template, as a raw
zstandard dictionary, saves over compressing the block alone. Going down that ranking, a block wins
if it shares no word with a winner and its exact wording confirms it: the words that tell licences
apart (names such as `lesser` or `nc`, and every version number) are those of the template. The
relative reduction and the differences in wording are returned.

Edge cases: null and empty texts have no notices; equal savings go to the fewest differences, then to
the first template by name, then to the first place; a notice that occurs again is found again; an
empty table gives an empty result; columns other than the id and the text are ignored. Memory is
bounded by one text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Notices by licence (fixed values: wording of the public notices). List marks are left out.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
TEMPLATES |= {f"{short}-{v}{'.0' if '.' not in v else ''}": f"This work is licensed under the {name}, version {v}." for short,
    name, versions in (("GPL", "GNU General Public License", "123"), ("AGPL", "GNU Affero General Public License", "3"),
    ("LGPL", "GNU Lesser General Public License", ("2.1", "3"))) for v in versions}
#: The terms of Creative Commons licences by their short names (fixed values); each has versions 1.0 to 4.0 here.
TERMS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
TEMPLATES |= {f"CC-{k}-{v}": f"Licensed under CC {k} {v}." for k in TERMS for v in VERSIONS}
TEMPLATES |= {f"CC-{k}-{v}-work": f"This work is licensed under a Creative Commons {name} {v} International License." for k,
    name in TERMS.items() for v in VERSIONS}
#: Words that tell licences apart, beside numbers: a block that lacks the template's, or has others, isn't of its licence.
TELLING = frozenset("apache bsd mit isc gnu gpl lgpl agpl lesser affero mozilla mpl eclipse epl boost zlib cc0 nc sa nd noncommercial sharealike noderivatives noderivs".split())
CUE = re.compile(r"(?i)licen[sc]|copyright|permission|redistribut|public\W+domain|creative\W+commons|free\W+software|\bCC\W+BY|implied\W+warranty")
#: Lines up to an empty one; the signs that may close a notice.
PARAGRAPH = re.compile(r"(?:[^\n]*\S[^\n]*(?:\n|\Z))+")
CLOSE = re.compile(r"[^\w\s(]*")
#: A candidate must shorten the notice by this share, and differ in at most this share of the template's words.
LEAST_REDUCTION, MOST_DIFFERENT = 0.2, 0.25
WORDS = re.compile(r"\w+(?:\.\w+)*")
NUMBER = re.compile(r"v?(\d+(?:\.[1-9]\d*)*)(?:\.0)*")


def folded(word: str) -> str:
    """A word in lower case; a number without a leading v and closing .0."""
    word = word.lower()
    return m[1] if (m := NUMBER.fullmatch(word)) else word


def telling(words: list[str]) -> frozenset[str]:
    """The words that the template and a block of its licence must both have."""
    return frozenset(w for w in words if w in TELLING or w[0].isdigit())


@lru_cache(maxsize=4)
def _compressors(templates: tuple[tuple[str, str], ...]):
    plain = zstandard.ZstdCompressor(level=19, write_content_size=False)
    with_text = {name: zstandard.ZstdCompressor(level=19, write_content_size=False,
        dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, text in templates}
    return plain, with_text


class Words:
    """The folded words of a text, with their places."""

    def __init__(self, text: str):
        found = list(WORDS.finditer(text))
        self.words, self.starts, self.ends = [folded(m[0]) for m in found], [m.start() for m in found], [m.end() for m in found]


def ends(template: list[str], block: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(differences, words kept, first word) of the nearest run of the block's words that ends before each place 0 to len(block): fewest words missing and added, then most kept."""
    known: dict[str, int] = {}
    a = np.array([known.setdefault(w, len(known)) for w in template])
    b = np.array([known.get(w, -1) for w in block])
    # One number holds all three: differences in units of `one`, less the words kept, above the first word.
    low = 1 << 32
    one = (len(a) + 1) * low
    steps = np.arange(len(b) + 1) * one
    cost = np.arange(len(b) + 1)
    for w in a:
        now = cost + one
        now[1:] = np.minimum(now[1:], np.where(b == w, cost[:-1] - low, now[1:]))
        cost = np.minimum.accumulate(now - steps) + steps
    first = cost % low
    rest = cost // low
    differ = -(-rest // (len(a) + 1))
    return differ, differ * (len(a) + 1) - rest, first


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str]]:
    """(words of the template that the block lacks, words of the block that the template lacks), as few as can be."""
    n, m = len(template), len(block)
    left = [[0] * (m + 1) for _ in range(n + 1)]  # longest common subsequence of what follows
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            left[i][j] = left[i + 1][j + 1] + 1 if template[i] == block[j] else max(left[i + 1][j], left[i][j + 1])
    missing, added, i, j = [], [], 0, 0
    while i < n or j < m:
        if i < n and j < m and template[i] == block[j]:
            i, j = i + 1, j + 1
        elif j == m or (i < n and left[i + 1][j] >= left[i][j + 1]):
            missing.append(template[i])
            i += 1
        else:
            added.append(block[j])
            j += 1
    return missing, added


def blocks(text: str, reach: int) -> list[tuple[int, Words, int, int]]:
    """(start of a paragraph, its words, from, to) of the runs of words within reach of a cue."""
    out = []
    for paragraph in PARAGRAPH.finditer(text):
        cues = [m.start() for m in CUE.finditer(paragraph[0])]
        if not cues:
            continue
        words = Words(paragraph[0])
        runs: list[list[int]] = []
        for at in cues:
            k = bisect_right(words.starts, at)
            if runs and k - reach <= runs[-1][1]:
                runs[-1][1] = min(len(words.words), k + reach)
            else:
                runs.append([max(0, k - reach), min(len(words.words), k + reach)])
        out += [(paragraph.start(), words, a, b) for a, b in runs]
    return out


@lru_cache(maxsize=4)
def _worded(templates: tuple[tuple[str, str], ...]) -> dict[str, tuple[list[str], Counter, int, frozenset[str]]]:
    """Each template's words, their counts, the most differences, and the words that tell it."""
    worded = {name: [folded(w) for w in WORDS.findall(t)] for name, t in templates}
    return {name: (w, Counter(w), int(MOST_DIFFERENT * len(w)), telling(w)) for name, w in worded.items() if w}


def candidates(block: list[str], worded: dict) -> list[tuple[int, int, str, int, int]]:
    """(words kept less differences, differences, template, first, end) of runs of the block near to a template: of those of one template that overlap, the best."""
    held, near = Counter(block), []
    for name, (template, bag, most, tells) in worded.items():
        if not tells <= held.keys() or sum((bag & held).values()) < len(template) - most:  # the wording can't match
            continue
        differ, kept, first = ends(template, block)
        taken = np.zeros(len(block), bool)
        at = np.flatnonzero((differ <= most) & (kept > 0))
        for e in at[np.lexsort((at, differ[at], (differ - kept)[at]))].tolist():
            if not taken[first[e] : e].any():
                taken[first[e] : e] = True
                near.append((int(kept[e] - differ[e]), int(differ[e]), name, int(first[e]), e))
    return near


def find(text: str, templates: dict[str, str]) -> list[tuple[int, int, str, float, list[str], list[str]]]:
    """(start, end, template, reduction, missing words, added words) of each notice in the text; positions are characters."""
    if not CUE.search(text):
        return []
    key = tuple(sorted(templates.items()))
    (plain, with_text), worded = _compressors(key), _worded(key)
    out = []
    for base, words, a, b in blocks(text, max((len(w) + most for w, _, most, _ in worded.values()), default=0)):
        block, ranked = words.words[a:b], []
        for _, differ, name, first, end in candidates(block, worded):
            start, stop = _widened(text, base, words, a + first, a + end, words.starts[a + first], words.ends[a + end - 1])
            data = text[start:stop].encode()
            alone = len(plain.compress(data))
            saved = alone - len(with_text[name].compress(data))
            ranked.append((-saved, differ, name, first, end, start, stop, saved / alone))
        taken = np.zeros(len(block), bool)
        for _, _, name, first, end, start, stop, reduction in sorted(ranked):
            if reduction < LEAST_REDUCTION or taken[first:end].any():
                continue
            missing, added = differences(worded[name][0], block[first:end])
            if not any(w in TELLING for w in added) and not telling(missing):  # the wording confirms it
                taken[first:end] = True
                out.append((start, stop, name, round(reduction, 6), missing, added))
    return sorted(out)


def _widened(text: str, base: int, words: Words, first: int, end: int, start: int, stop: int) -> tuple[int, int]:
    """The place in the text of a run of words, with the signs beside it: those of its line where no word stands there too, else the sentence's end."""
    start, stop = base + start, base + stop
    low, high = text.rfind("\n", 0, start) + 1, text.find("\n", stop)
    high = len(text) if high < 0 else high
    if first == 0 or base + words.ends[first - 1] <= low:
        start = low + len(text[low:start]) - len(text[low:start].lstrip())
    if end == len(words.words) or base + words.starts[end] >= high:
        stop = stop + len(text[stop:high].rstrip())
    else:
        stop = CLOSE.match(text, stop).end()
    return start, stop


SCHEMA = "start long, end long, license string, reduction double, missing array<string>, added array<string>"


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """id_col and one row for each notice found: start, end, license, reduction, missing and added words. No shuffle."""
    common.prepare(df.sparkSession)
    templates = templates or TEMPLATES

    def run(batches):
        for batch in batches:
            rows = [(i, *found) for i, t in enumerate(batch.column("text").to_pylist()) if t for found in find(t, templates)]
            if rows:
                i, a, b, name, r, missing, added = zip(*rows, strict=True)
                words = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(a, pa.int64()),
                    pa.array(b, pa.int64()), pa.array(name), pa.array(r), pa.array(missing, words), pa.array(added, words)],
                    names=[id_col, "start", "end", "license", "reduction", "missing", "added"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} {kind}, {SCHEMA}")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """The notices in all documents."""
    return license_scan(common.documents(spark, sf_dir))
