"""License scan by conditional compression.

The words around every cue, as many as the longest template has, make a block; blocks that meet are one, so line ends and blank
lines never cut a notice. Blocks are cut into windows that overlap by more than any match is long. Each window is compressed by
zstandard alone and with every template as a raw-content dictionary; templates are ranked by what their dictionary takes off.
From the largest reduction down to `least` of what the template takes off its own text, each is confirmed by wording: it is
aligned where it shares the longest run of words, must be matched to at least `share` with every key word (names and version
numbers), and its exact differences are reported. Of matches whose key words all belong to another one (a line within the full
notice), only the one that its template's dictionary makes smaller stays; ties go to fewer differences, then to the name.

All by row, and linear in a text's length: a regular expression in the JVM keeps most texts from Python, and there is no shuffle.
Null and empty texts and texts without cues give no rows. Each match gives a row, repeated rows of the table each give theirs.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUES = r"(?i)licen[sc]e|copyright|permission\s+is|redistribut|warrant|spdx|public\s+domain|creative\s+commons|unencumbered|\bcc[ -]?(?:by|0|zero)\b|\b[al]?gpl-?\d|\bmpl-?\d|\bbsd-\d|apache-\d"

#: Wording of common notices, and the words that tell them from their kin.
TEMPLATES = {
    "Apache-2.0-line": ("Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    "Apache-2.0": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "apache 2.0"),
    "MIT-line": ("Released under the MIT License.", "mit"),
    "MIT": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.', "permission sublicense"),
    "GPL-3.0-line": ("This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    "GPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general 3"),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gnu general 2"),
    "LGPL-3.0-line": ("This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    "AGPL-3.0-line": ("This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "redistribution neither endorse"),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistribution binary"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla 2.0"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "permission fee"),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unencumbered public domain"),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0 Universal.", "cc0 1.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "by 4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "by-sa 4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "by-nc 4.0"),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "by-nc-sa 4.0"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "by-nd 4.0"),
}

#: Identifiers of the machine-readable form, and the short statements that name a license.
IDENTIFIERS = ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")
TEMPLATES |= {f"{i}-spdx": (f"SPDX-License-Identifier: {i}", f"spdx-license-identifier {i.lower()}") for i in IDENTIFIERS}
TEMPLATES |= {f"{i}-statement": (f"Distributed under {i}.", i.lower()) for i in ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause")}
TEMPLATES |= {f"{n}-licensed": (f"This project is {n} licensed.", f"{n.lower()} licensed") for n in ("MIT", "Apache-2.0", "BSD-3-Clause")}

_WORDS = re.compile(r"[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*")
_SCHEMA = "doc_id long, block_start long, block_end long, license string, saved_bytes long, reduction double, share double, n_differences long, differences string"


def blocks(text: str, cue: re.Pattern, around: int) -> Iterator[list[tuple[int, int, str]]]:
    """Words (start, end, lower case) of each block: `around` words on both sides of every cue."""
    words = [(m.start(), m.end(), m.group().lower()) for m in _WORDS.finditer(text)]
    ends = [w[1] for w in words]
    ranges: list[list[int]] = []
    for m in cue.finditer(text):
        at = bisect.bisect_right(ends, m.start())
        low, high = max(0, at - around), min(len(words), at + around + 1)
        if ranges and low <= ranges[-1][1]:
            ranges[-1][1] = high
        else:
            ranges.append([low, high])
    for low, high in ranges:
        yield words[low:high]


def wording(block: list, template: list[str]) -> tuple[float, list[str], list[int]]:
    """Share of the template's words that the block has in order, what differs within the matched stretch, and the places matched."""
    ops = difflib.SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    for side in (0, -1):  # words before and after the stretch, and single words far from it, belong to the document
        while ops:
            edge = [i for i, op in enumerate(ops) if op[0] == "equal"]
            if not edge:
                break
            first = edge[side]
            apart = ops[first + 1 : edge[1]] if side == 0 and len(edge) > 1 else ops[edge[-2] + 1 : first] if side and len(edge) > 1 else []
            if sum(op[4] - op[3] for op in apart) <= 2 * (ops[first][2] - ops[first][1]):
                break
            op, a, b, c, d = ops[first]
            ops[first] = ("replace", a, b, c, d)
    edge = [i for i, op in enumerate(ops) if op[0] == "equal"]
    places = [k for op, _, _, c, d in ops if op == "equal" for k in range(c, d)]
    out = []
    for i, (op, a, b, c, d) in enumerate(ops):
        extra = [w for w in block[c:d] if w] if edge and edge[0] < i < edge[-1] else []
        if op != "equal" and (a < b or extra):
            out.append(f"-[{' '.join(template[a:b])}] +[{' '.join(extra)}]")
    return len(places) / max(1, len(template)), out, places


def matches(words: list[str], template: list[str], keys: set[str], share: float) -> Iterator[tuple[float, list[str], list[int]]]:
    """Every stretch of `words` that confirms the template: each longest shared run in turn, with what is around it."""
    left: list = list(words)
    n = len(template)
    # a match of `share` in at most as many pieces as words may be missing, and one more, has a run of this many words
    least = max(2, int(share * n / ((1 - share) * n + 1)))
    while keys <= set(left):
        run = difflib.SequenceMatcher(None, template, left, autojunk=False).find_longest_match()
        if run.size < min(least, n):
            return
        low = max(0, run.b - run.a - n // 2 - 8)
        got, differ, places = wording(left[low : run.b - run.a + n + n // 2 + 8], template)
        places = [low + k for k in places]
        if got >= share and keys <= {left[k] for k in places}:
            yield got, differ, places
        else:
            places = range(run.b, run.b + run.size)
        for k in places:
            left[k] = None


class Template:
    """A notice as words, key words and a compressor that knows it; `worth` is what it takes off its own text."""

    def __init__(self, name: str, text: str, keys: str):
        import zstandard

        self.name, self.words, self.keys = name, _WORDS.findall(text.lower()), set(keys.split())
        self.own = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(" ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.raw = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(" ".join(text.split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        plain = zstandard.ZstdCompressor(level=6)
        self.worth = len(plain.compress(" ".join(self.words).encode())) - len(self.own.compress(" ".join(self.words).encode()))


def windows(block: list, longest: int) -> Iterator[tuple[int, list]]:
    """(first word, words) of stretches of a block that overlap by more than a match and its surroundings can have."""
    overlap = 2 * longest + 32
    size = 2 * overlap
    for low in range(0, max(1, len(block) - overlap), size - overlap):
        yield low, block[low : low + size]


def ranked(words: list[str], templates: list[Template], plain, least: float) -> list[tuple[int, Template]]:
    """(bytes taken off, template) of a window, largest first, down to `least` of each template's own worth."""
    data = " ".join(words).encode("utf-8", "surrogatepass")
    alone = len(plain.compress(data))
    sizes = ((alone - len(t.own.compress(data)), t) for t in templates)
    return sorted((x for x in sizes if x[0] >= least * x[1].worth), key=lambda x: (-x[0], x[1].name))


def found_in(text: str, block: list, templates: list[Template], plain, share: float, least: float) -> list[tuple]:
    """Confirmed matches of a block, each key word counted for one of them: (start, end, name, saved, reduction, share, differences)."""
    found: dict[tuple, tuple] = {}
    for low, part in windows(block, max((len(t.words) for t in templates), default=0)):
        words = [w for _, _, w in part]
        for _, t in ranked(words, templates, plain, least):
            for got, differ, places in matches(words, t.words, t.keys, share):
                a, b = part[places[0]][0], part[places[-1]][1]
                raw = " ".join(text[a:b].split()).encode("utf-8", "surrogatepass")
                alone = len(plain.compress(raw))
                saved = alone - len(t.raw.compress(raw))
                at = {low + k for k in places}
                if saved > 0:
                    found[a, b, t.name] = (-saved, len(differ), t.name, at, {k for k in at if words[k - low] in t.keys}, (a, b, t.name, saved, saved / alone, got, len(differ), " ".join(differ)))
    taken: set[int] = set()
    out = []
    for _, _, _, places, at, row in sorted(found.values(), key=lambda x: (*x[:3], x[5][:2])):
        if not at <= taken:
            taken.update(places)
            out.append(row)
    return sorted(out, key=lambda r: r[:3])


def _scan(templates: dict[str, tuple[str, str]], share: float, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        cue, plain = re.compile(CUES), zstandard.ZstdCompressor(level=6)
        known = [Template(name, text, keys) for name, (text, keys) in templates.items()]
        around = max((len(t.words) for t in known), default=0)
        for batch in batches:
            rows = [(doc, *row) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for block in blocks(text, cue, around) for row in found_in(text, block, known, plain, share, least)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "block_start", "block_end", "license", "saved_bytes", "reduction", "share", "n_differences", "differences"])

    return run


def license_blocks(
    documents: DataFrame, templates: dict[str, tuple[str, str]] | None = None, share: float = 0.8, least: float = 0.25,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row for each confirmed match of a template: its character range, license, bytes saved, share of the template matched, differences.

    templates: name -> (wording, key words). least: part of a template's own worth that a window must get smaller by.
    """
    docs = documents.where(F.col(text_col).rlike(CUES)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_scan(templates or TEMPLATES, share, least), _SCHEMA)
