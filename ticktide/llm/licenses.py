"""License texts in documents.

Words are runs of letters and digits, A-Z as a-z. Templates are grouped by length. For each group a document is cut into
overlapping windows, long enough that some window holds all of any passage of the group's length. A window retrieves a
template where their MinHash bands agree, one hash a band; the number of bands is set so that a window with the least
containment is missed with a chance of at most MISS. A window without any shingle of a template agrees with none in any band, so
bands are run only over windows that hold one. Retrieved windows are then compared shingle by shingle: the share of the
template's shingles that the window holds must reach the threshold.

Templates shorter than a shingle are one shingle of all their words. Null or empty text: no match. A text of any length is
searched whole. Repeated rows: each is searched. Ties between windows: the first. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.llm import common, near_dups, tokens

SHINGLE, THRESHOLD, MISS = 5, 0.8, 1e-6
#: Words of a template at most, by group.
GROUPS = (5, 12, 32, 80, 200)
#: Public license notices by SPDX identifier.
TEMPLATES = {
    "all-rights-reserved": ["All rights reserved."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}

_blank = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_word = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")


def words(text: str) -> list[str]:
    return _word.findall("".join(c.lower() if c < "\x80" else c for c in text))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    rolled = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(rolled)]
    return common.mix(rolled)


class Group:
    """Templates of up to `longest` words, with the MinHash of each in every band."""

    def __init__(self, longest: int, templates: list[tuple[str, str]], threshold: float):
        self.templates = templates
        lists = [words(t) for _, t in templates]
        shortest = min(map(len, lists))
        self.size = min(SHINGLE, shortest)
        self.shingles = [{tuple(w[i : i + self.size]) for i in range(len(w) - self.size + 1)} for w in lists]
        self.step = max(1, longest // 4) if longest > SHINGLE else 1
        self.window = longest + self.step - 1  # words: every passage of `longest` words is in some window
        self.blocks = -(-(self.window - self.size + 1) // self.step)
        few = min(map(len, self.shingles))
        union = self.blocks * self.step + max(1, round(few * (1 - threshold)))
        least = max(1, math.ceil(threshold * few)) / union  # Jaccard of a window that just reaches the threshold
        self.bands = 1 if self.window == self.size else math.ceil(math.log(MISS) / math.log1p(-least))
        own = [shingle_hashes(near_dups.word_hashes(pa.array([t]), _blank)[0], self.size) for _, t in templates]
        self.minima = [np.array([banded(h, k).min() for h in own]) for k in range(self.bands)]
        self.known = [np.unique(m) for m in self.minima]
        self.every = np.unique(np.concatenate(own))
        self.ends = np.zeros(1 << 16, bool)  # of the templates' shingles' hashes
        self.ends[(self.every & np.uint64(0xFFFF)).astype(np.int64)] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of shingles that some template has."""
        at = np.flatnonzero(self.ends[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.every, hashes[at]), len(self.every) - 1)
        return at[self.every[spot] == hashes[at]]


def banded(hashes: np.ndarray, band: int) -> np.ndarray:
    """The shingles' values in a band's order."""
    factor = np.uint64((0x9E3779B97F4A7C15 * (2 * band + 1)) % (1 << 64) | 1)
    x = (hashes ^ np.uint64(0xA0761D6478BD642F * (band + 1) % (1 << 64))) * factor
    return x ^ (x >> np.uint64(32))


def groups(templates: dict[str, list[str]], threshold: float) -> list[Group]:
    by = defaultdict(list)
    for name, texts in templates.items():
        for text in texts:
            n = len(words(text))
            by[next((g for g in GROUPS if n <= g), n), min(n, SHINGLE)].append((name, text))
    return [Group(longest, some, threshold) for (longest, _), some in sorted(by.items())]


#: Shingles whose bands are computed at once.
AT_ONCE = 1 << 18


def retrieved(group: Group, hashes: np.ndarray, at: np.ndarray) -> set[tuple[int, int, int]]:
    """(document, first word of a window, template) where a band agrees. at: where each document's words begin, with the end."""
    own = shingle_hashes(hashes, group.size)
    place = group.has(own)
    doc = np.searchsorted(at, place, side="right") - 1
    inside = place + group.size <= at[doc + 1]
    place, doc = place[inside], doc[inside]
    if not len(place):
        return set()
    cell = (place - at[doc]) // group.step  # windows start every step shingles and are some cells long
    spread = np.repeat(cell, group.blocks) - np.tile(np.arange(group.blocks), len(cell))
    windows = np.unique(np.stack([np.repeat(doc, group.blocks), spread])[:, spread >= 0], axis=1)
    doc, cell = windows
    start = at[doc] + cell * group.step
    counts = np.minimum(group.blocks * group.step, at[doc + 1] - group.size + 1 - start)
    found, few = set(), max(1, AT_ONCE // (group.blocks * group.step))
    for i in range(0, len(doc), few):
        n = counts[i : i + few]
        values, offsets = own[tokens.ragged(start[i : i + few], n)], np.cumsum(n) - n
        for band in range(group.bands):
            low = np.minimum.reduceat(banded(values, band), offsets)
            known = group.known[band]
            spot = np.minimum(np.searchsorted(known, low), len(known) - 1)
            for k in np.flatnonzero(known[spot] == low).tolist():
                for t in np.flatnonzero(group.minima[band] == low[k]).tolist():
                    found.add((int(doc[i + k]), int(cell[i + k]) * group.step, t))
    return found


MATCHES = "doc_id long, license string, containment double, word_start long, word_end long"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document and license found: the best window, its words' places and the share of the template in it."""
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        all_groups = groups(chosen, threshold)
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                hashes, at = near_dups.word_hashes(part.column("text"), _blank)
                best: dict[tuple[int, str], tuple[float, int, int]] = {}
                texts: dict[int, list[str]] = {}
                for group in all_groups:
                    for doc, first, t in sorted(retrieved(group, hashes, at)):
                        if doc not in texts:
                            texts[doc] = words(part.column("text")[doc].as_py())
                        some = texts[doc][first : first + group.blocks * group.step + group.size - 1]
                        held = {tuple(some[i : i + group.size]): i for i in range(len(some) - group.size, -1, -1)}
                        met = group.shingles[t] & held.keys()
                        share = len(met) / len(group.shingles[t])
                        if share >= threshold:
                            places = [held[s] for s in met]
                            key, found = (doc, group.templates[t][0]), (share, -first - min(places), first + max(places) + group.size)
                            best[key] = max(best.get(key, found), found)
                rows = sorted(best.items())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array([d for (d, _), _ in rows], pa.int64())).cast(pa.int64()), pa.array([n for (_, n), _ in rows], pa.string()), pa.array([x[0] for _, x in rows], pa.float64()), pa.array([-x[1] for _, x in rows], pa.int64()), pa.array([x[2] for _, x in rows], pa.int64())],
                    ["doc_id", "license", "containment", "word_start", "word_end"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, MATCHES)
