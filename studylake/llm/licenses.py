"""Operator 7: license scans by conditional compression.

Stretches of text around license words are compressed once alone and once with each template as zstandard raw-content
dictionary. Templates are ranked by how many bytes they save; those that save enough are confirmed by their exact
wording: an alignment counts the words that differ and shows them.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, rows_of, to_batches

# Words that make a stretch a candidate, in lower case.
TRIGGERS = ("licens", "licenc", "copyright", "permission", "redistribut", "warrant", "public domain", "spdx", "endorse or promote")
# Wordings of public licenses: notices, and paragraphs that only one license has.
WORDINGS = (
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. The software is provided as is and the author disclaims all warranties"),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)
# Families of licenses with their versions, and the further names that have SPDX identifiers alone.
GNU = (("GPL", "General", ("1.0", "2.0", "3.0")), ("LGPL", "Library General", ("2.0",)), ("LGPL", "Lesser General", ("2.1", "3.0")), ("AGPL", "Affero General", ("1.0", "3.0")))
CREATIVE_COMMONS = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
CC_VERSIONS = (("2.0", ""), ("2.5", ""), ("3.0", " Unported"), ("4.0", " International"))


def _templates() -> tuple[tuple[str, str], ...]:
    """All wordings, with those of families made of their names and versions."""
    out = list(WORDINGS)
    for short, name, versions in GNU:
        for version in versions:
            license_id, number = f"{short}-{version}", version.removesuffix(".0")
            out += [(license_id, f"licensed under the GNU {name} Public License, version {number}"), (license_id, f"it under the terms of the GNU {name} Public License as published by the Free Software Foundation, either version {number} of the License, or (at your option) any later version")]
            out += [(license_id, f"SPDX-License-Identifier: {license_id}-{which}") for which in ("only", "or-later")]
    for short, name in CREATIVE_COMMONS:
        for version, kind in CC_VERSIONS:
            out += [(f"CC-{short}-{version}", f"licensed under CC {short} {version}"), (f"CC-{short}-{version}", f"licensed under a Creative Commons {name} {version}{kind} License")]
    plain = dict.fromkeys(name for name, _ in WORDINGS if not re.match("A?GPL|BSD$|Proprietary", name))
    return tuple(out + [(name, f"SPDX-License-Identifier: {name}") for name in plain])


TEMPLATES = _templates()
# Words that tell licenses of one family apart.
TELLING = frozenset((
    "lesser", "library", "affero", "sharealike", "noncommercial", "noderivatives", "attribution", "attribution-sharealike", "attribution-noncommercial",
    "attribution-noderivatives", "attribution-noncommercial-sharealike", "attribution-noncommercial-noderivatives", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd",
))
#: Characters taken on both sides of a trigger (stretches that touch are joined), bytes that a template has to save, and
#: the words of a wording that may differ: one in so many.
REACH, LEAST_SAVED, ONE_IN = 400, 3, 10

_WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")


def stretches(text: str) -> list[tuple[int, int]]:
    """Where triggers stand, with their surroundings, in order and apart."""
    low = text.lower()
    if len(low) != len(text):  # few characters change length in lower case; keep places right
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = sorted(m.start() for t in TRIGGERS if t in low for m in re.finditer(re.escape(t), low))
    out: list[list[int]] = []
    for hit in hits:
        start, end = max(0, hit - REACH), min(len(text), hit + REACH)
        if out and start <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


@functools.lru_cache(maxsize=4)
def _compressors(templates: tuple[tuple[str, str], ...]):
    level = dict(level=9, write_content_size=False)
    out = [
        (name, wording, [_plain(w) for w in _WORD.findall(wording)], zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(wording.lower().encode("utf-8"), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **level))
        for name, wording in templates
    ]
    return zstandard.ZstdCompressor(**level), out


def _plain(word: str) -> str:
    """A word in lower case; version numbers without `v` before and `.0` behind."""
    number = re.fullmatch(r"v?\.?(\d+(?:\.\d+)*?)(?:\.0)*", word.lower())
    return number[1] if number else word.lower()


def aligned(template: list[str], words: list[str]) -> tuple[int, int, int]:
    """The place in `words` that takes the fewest changed, left out or added words to be `template`: changes, start, end.

    A number of the template that is changed or left out, and a word that tells licenses apart that is changed, left out
    or added, counts for more than the whole template: such wordings are another license's.
    """
    m, n = len(template), len(words)
    index = {w: k for k, w in enumerate(dict.fromkeys([*template, *words]))}
    b = np.array([index[w] for w in words], np.int64)
    much = m + 1
    of_word = np.array([much if w in TELLING else 1 for w in words], np.int64)
    added = np.concatenate(([0], np.cumsum(of_word)))  # of words added before each place
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    big = n + m + 2
    for word in template:
        own = much if word in TELLING or any(c.isdigit() for c in word) else 1
        # each entry is cost and start in one number, so that a least cost takes its start along
        packed = cost * big + (big - 1 - start)
        step = np.full(n + 1, packed[0] + big * own)
        step[1:] = np.minimum(packed[:-1] + big * np.where(b == index[word], 0, np.maximum(own, of_word)), packed[1:] + big * own)
        step = np.minimum.accumulate(step - big * added) + big * added
        cost, start = step // big, big - 1 - step % big
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


def find(text: str | None, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple]:
    """Confirmed licenses: start, end (characters), name, saved (share of the compressed size), differences, wording found.

    In order of place. Templates are confirmed in the order of the bytes they save, and of wordings that overlap the one
    that saves more is taken; between equal savings the one with fewer differences, then the longer one.
    """
    out: list[tuple] = []
    plain, compressors = _compressors(templates)
    for begin, end in stretches(text or ""):
        part = text[begin:end]
        spots = [(m.start(), m.end(), _plain(m.group())) for m in _WORD.finditer(part)]
        words = [w for _, _, w in spots]
        if not words:
            continue
        data = part.lower().encode("utf-8")
        alone = len(plain.compress(data))
        ranked = sorted(((alone - len(c.compress(data))), k) for k, (_, _, _, c) in enumerate(compressors))[::-1]
        found = []
        for saved, k in ranked:
            if saved < LEAST_SAVED:
                break
            name, _, template, _ = compressors[k]
            # the wording may come again: what lies on both sides of a match is searched on its own
            todo = [(0, len(words))]
            while todo:
                low, high = todo.pop()
                if high - low < len(template) - len(template) // ONE_IN:
                    continue
                changes, a, b = aligned(template, words[low:high])
                if changes > len(template) // ONE_IN or b <= a:
                    continue
                found.append((-saved, changes, -len(template), low + a, low + b, name))
                todo += [(low, low + a), (low + b, high)]
        taken: list[tuple[int, int]] = []
        for less, changes, _, a, b, name in sorted(found):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                out.append((begin + spots[a][0], begin + spots[b - 1][1], name, -less / alone, changes, part[spots[a][0] : spots[b - 1][1]]))
    return sorted(out)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Licenses in whole texts. Returns `id_col` and found, an array of struct start, end, license, saved, changes, wording.

    Null, empty and clean texts give an empty array. Rows stay one to one, repeated ones and null ids included; other
    columns are left out, whatever their names. Very long texts are searched whole, stretch by stretch. Ties are settled
    by `find`.
    """
    fields = [("start", pa.int64(), T.LongType()), ("end", pa.int64(), T.LongType()), ("license", pa.string(), T.StringType()), ("saved", pa.float64(), T.DoubleType()), ("changes", pa.int64(), T.LongType()), ("wording", pa.string(), T.StringType())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, a) for n, a, _ in fields]))
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), ("found", kind)])
            yield from to_batches(((i, [dict(zip((n for n, _, _ in fields), hit)) for hit in find(text, templates)]) for i, text in rows_of([batch])), schema)

    out = T.StructType([df.schema[id_col], T.StructField("found", T.ArrayType(T.StructType([T.StructField(n, t) for n, _, t in fields])))])
    return df.select(id_col, F.col(text_col).cast("string").alias("__text")).transform(in_batches, run, out)
