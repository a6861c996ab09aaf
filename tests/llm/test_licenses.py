"""The license scan against a plain version of itself, and wordings of one family that differ by a version or a name."""

import re

import pytest
import zstandard

from studylake.llm import licenses as L

NOTICE = "it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(("text", "want"), [
    (NOTICE.format("General", "2"), "GPL-2.0"), (NOTICE.format("General", "3"), "GPL-3.0"), (NOTICE.format("General", "3.0"), "GPL-3.0"), (NOTICE.format("General", "9"), None), (NOTICE.format("General", "2.1"), None),
    (NOTICE.format("Lesser General", "2.1"), "LGPL-2.1"), (NOTICE.format("Lesser General", "3"), "LGPL-3.0"), (NOTICE.format("Lesser General", "2"), None), (NOTICE.format("Library General", "2"), "LGPL-2.0"), (NOTICE.format("Affero General", "3"), "AGPL-3.0"),
    ("licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"), ("licensed under the GNU General Public License, version 9", None),
    ("Licensed under the Apache License, Version 2.0", "Apache-2.0"), ("Licensed under the Apache License, Version 1.1", None),
    ("licensed under CC BY 3.0", "CC-BY-3.0"), ("licensed under CC BY 4.0", "CC-BY-4.0"), ("licensed under CC BY-SA 3.0", "CC-BY-SA-3.0"), ("licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("licensed under CC BY 7.0", None),
    ("licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC-BY-SA-3.0"), ("licensed under a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1"), ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"),
    ("are made available under the terms of the Eclipse Public License v1.0. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "EPL-1.0"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Zlib"),
])
def test_versions_and_names_are_exact(text, want):
    assert {x[2] for x in L.find(f"Read this first. {text}\nAnd go on.")} == ({want} if want else set())


def plain_alignment(template, words):
    """Changes, start and end by a table of all cells; of equal costs the later start, then the earlier end."""
    much = len(template) + 1
    heavy = lambda w: much if w in L.TELLING else 1
    row = [(0, -j) for j in range(len(words) + 1)]
    for t in template:
        own = much if t in L.TELLING or any(c.isdigit() for c in t) else 1
        new = [(row[0][0] + own, row[0][1])]
        for j, w in enumerate(words):
            swap = 0 if w == t else max(own, heavy(w))
            new.append(min((row[j][0] + swap, row[j][1]), (row[j + 1][0] + own, row[j + 1][1]), (new[j][0] + heavy(w), new[j][1])))
        row = new
    end = min(range(len(row)), key=lambda j: row[j][0])
    return row[end][0], -row[end][1], end


def plain_find(text):
    """The scan by its rules, one template after the other."""
    level = dict(level=9, write_content_size=False)
    out = []
    for begin, end in L.stretches(text):
        part = text[begin:end]
        spots = [(m.start(), m.end(), L._plain(m.group())) for m in L._WORD.finditer(part)]
        alone = len(zstandard.ZstdCompressor(**level).compress(part.lower().encode()))
        found = []
        for k, (name, wording) in enumerate(L.TEMPLATES):
            template = [L._plain(w) for w in L._WORD.findall(wording)]
            primer = zstandard.ZstdCompressionDict(wording.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            saved = alone - len(zstandard.ZstdCompressor(dict_data=primer, **level).compress(part.lower().encode()))
            todo = [(0, len(spots))] if saved >= L.LEAST_SAVED else []
            while todo:
                low, high = todo.pop()
                changes, a, b = plain_alignment(template, [w for _, _, w in spots[low:high]])
                if high - low >= len(template) - len(template) // L.ONE_IN and changes <= len(template) // L.ONE_IN and b > a:
                    found.append((-saved, changes, -len(template), low + a, low + b, name))
                    todo += [(low, low + a), (low + b, high)]
        taken = []
        for _, changes, _, a, b, name in sorted(found):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                out.append((begin + spots[a][0], begin + spots[b - 1][1], name, changes))
    return sorted(out)


def test_scan_equals_its_plain_version(spark):
    small = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r["text"] and L.stretches(r["text"])]
    mixed = ["no license", NOTICE.format("Lesser General", "2.1") + " then " + NOTICE.format("General", "3"), "Licensed under the MIT License and licensed under CC BY-SA 3.0", "it under the terms of the GNU Public License as issued by the Free Software Foundation, either version 3 of the License"]
    mixed.append("word " * 5000 + "Released under the MIT License" + " word" * 5000)
    for text in mixed + small[:12]:
        assert [(a, b, name, changes) for a, b, name, _, changes, _ in L.find(text)] == plain_find(text), text[:200]
    assert any(plain_find(t) for t in mixed) and re
