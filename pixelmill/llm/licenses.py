"""License scans by conditional compression.

A stretch of text that repeats a license's wording compresses far better with that license as a
zstandard raw dictionary than without.  Blocks around licensing words are the candidates; the
templates whose words a block holds are compared word by word, and the differences decide.
Where confirmed stretches overlap, the one with the largest reduction stays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wordings of public licenses and notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Licensing words; a line break and a comment's prefix may lie between two.
ANCHOR = regex.compile(rb"(?i)licen[cs]|copyright|permission[^a-z0-9]+is|rights[^a-z0-9]+reserved|redistribut|public[^a-z0-9]+domain|mozilla[^a-z0-9]+public|creative[^a-z0-9]+commons|\bcc[^a-z0-9]+by\b")
WORD = regex.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Words compared at once; longer blocks are cut with an overlap of half.
WINDOW = 4096


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


RUN = regex.compile(rb"(?i)[a-z0-9]+(?:\.[0-9]+)*")


def blocks(text: bytes, reach: int) -> Iterator[tuple[int, int]]:
    """(start, end) bytes of candidate blocks: licensing words and ``reach`` words on both sides, whatever the lines."""
    anchors = [(m.start(), m.end()) for m in ANCHOR.finditer(text)]
    if not anchors:
        return
    words = np.array([m.span() for m in RUN.finditer(text)], np.int64)
    first = last = None
    for a, b in anchors:  # words that the licensing word touches, then as many as the reach
        i = max(0, int(np.searchsorted(words[:, 1], a, "right")) - reach)
        j = min(len(words), int(np.searchsorted(words[:, 0], b)) + reach)
        if last is not None and i <= last:
            last = j
            continue
        if last is not None:
            yield int(words[first, 0]), int(words[last - 1, 1])
        first, last = i, j
    yield int(words[first, 0]), int(words[last - 1, 1])


def differences(block: list[str], template: list[str]) -> tuple[int, int, int, list[str]]:
    """Fewest word edits that turn some stretch of ``block`` into the whole template.

    (edits, first word, end word, the template's words that are missing or changed).
    """
    n, m = len(template), len(block)
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[:, 0] = np.arange(n + 1)
    names = {w: i for i, w in enumerate(dict.fromkeys(block))}
    x, steps = np.array([names[w] for w in block], np.int64), np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (x != names.get(template[i - 1], -1)))
        row = np.concatenate(([i], row))
        cost[i] = np.minimum.accumulate(row - steps) + steps  # inserted words
    i, j = n, int(np.argmin(cost[n]))
    edits, end, lost = int(cost[n, j]), j, []
    while i:
        if j and cost[i, j] == cost[i - 1, j - 1] + (block[j - 1] != template[i - 1]):
            if block[j - 1] != template[i - 1]:
                lost.append(template[i - 1])
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            lost.append(template[i - 1])
            i -= 1
        else:
            j -= 1
    return edits, j, end, lost[::-1]


@dataclass(frozen=True)
class Match:
    license: str
    reduction: float
    edits: int
    exact: bool
    first: int
    end: int


class Matcher:
    def __init__(self, templates: dict[str, str], tolerance: float = 0.1):
        self.plain = zstandard.ZstdCompressor(level=19, write_content_size=False)
        self.words = {k: w for k in sorted(templates) if (w := words_of(templates[k]))}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.given = {k: self._compressor(templates[k]) for k in self.words}
        self.tolerance = tolerance
        #: Words that a stretch may lie away from a licensing word in it.
        self.reach = max((int((1 + tolerance) * len(w)) + 1 for w in self.words.values()), default=1)

    @staticmethod
    def _compressor(text: str) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(" ".join(words_of(text)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=19, dict_data=held, write_content_size=False)

    def matches(self, words: list[str]) -> list[Match]:
        """Confirmed licenses of a block by their first word; each stretch of words tells one.

        What lies before, between and after confirmed stretches is searched again until nothing is confirmed.
        """
        out, open_parts = [], [(0, len(words))]
        while open_parts:
            start, stop = open_parts.pop()
            rated = []
            for at in range(start, max(start + 1, stop - WINDOW // 2), WINDOW // 2):
                rated += self._confirmed(words, at, min(stop, at + WINDOW))
            kept: list[Match] = []
            for _, _, x in sorted(rated, key=lambda r: (r[0], r[1], r[2].license, r[2].first)):
                if all(x.end <= y.first or x.first >= y.end for y in kept):
                    kept.append(x)
            if kept:
                edges = [start, *(e for x in sorted(kept, key=lambda x: x.first) for e in (x.first, x.end)), stop]
                open_parts += [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
                out += kept
        return sorted(out, key=lambda x: x.first)

    def _confirmed(self, words: list[str], start: int, stop: int) -> list[tuple[int, int, Match]]:
        """(-bytes saved, edits, match) of the best stretch of each template in words[start:stop]."""
        part, out = words[start:stop], []
        have = Counter(part)
        for k, template in self.words.items():
            allowed = int(self.tolerance * len(template))
            if sum((self.counts[k] - have).values()) > allowed:  # each word that isn't there is an edit
                continue
            edits, first, end, lost = differences(part, template)
            versions = any(any(ch.isdigit() for ch in w) for w in lost)  # another version is another license
            if edits > allowed or versions:
                continue
            body = " ".join(part[first:end]).encode()
            alone = len(self.plain.compress(body))
            gain = alone - len(self.given[k].compress(body))
            out.append((-gain, edits, Match(k, gain / alone, edits, edits == 0, start + first, start + end)))
        return out


_MATCHERS: dict = {}


def _characters(text: bytes | None, places: list[int]) -> dict[int, int]:
    """Characters before each of these bytes, in one pass."""
    out, last, n = {}, 0, 0
    for p in sorted(set(places)):
        n += len(text[last:p].decode("utf-8", "replace"))
        out[p] = n
        last = p
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, tolerance: float = 0.1) -> DataFrame:
    """One row for each license found: doc_id, start, length (characters of the lines that hold it), license, reduction, edits, exact, words_start, words_length (characters of its confirmed words).

    Whole texts are scanned.  reduction: share of the stretch's compressed size that the template
    saves.  A license is confirmed if at most ``tolerance`` of the template's words differ and no
    version number does.  Null and empty texts and texts without a licensing word give no row;
    repeated rows each give theirs.
    """
    templates = dict(templates or TEMPLATES)
    key = (tuple(sorted(templates.items())), tolerance)

    @F.pandas_udf("array<struct<start: long, length: long, license: string, reduction: double, edits: int, exact: boolean, words_start: long, words_length: long>>")
    def found(texts: pd.Series) -> pd.Series:
        if key not in _MATCHERS:
            _MATCHERS[key] = Matcher(templates, tolerance)
        m, out = _MATCHERS[key], []
        for t in texts:
            rows = []
            for start, end in blocks(t, m.reach) if t else ():
                spans = [w.span() for w in RUN.finditer(t, start, end)]
                for x in m.matches([t[a:b].decode().lower() for a, b in spans]):
                    a, b = t.rfind(b"\n", 0, spans[x.first][0]) + 1, t.find(b"\n", spans[x.end - 1][1])
                    b = len(t) if b < 0 else b
                    rows.append((a, b, spans[x.first][0], spans[x.end - 1][1], x))
            at = _characters(t, [v for r in rows for v in r[:4]])
            out.append([(at[a], at[b] - at[a], x.license, x.reduction, x.edits, x.exact, at[c], at[d] - at[c]) for a, b, c, d, x in rows])
        return pd.Series(out)

    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(found(F.col(text).cast("binary"))).alias("x")).select("doc_id", "x.*")
