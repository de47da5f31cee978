"""License scans by conditional compression.

Candidate blocks are the sentences that hold a license word, over line ends but not over blank lines. Each is
compressed alone and with every template as a zstandard raw dictionary; templates are ranked by how many
bytes that saves. In this order each is confirmed by exact wording, as often as it occurs: each of its words must stand in the block
in their order as one run, but for up to DIFFERENCES words, and words that tell one license from another (names, versions) may
not differ. Of matches that overlap the one that saves more stays. Templates are notices, sentences of the
licenses' own texts, and SPDX identifiers.

A null or empty text has no licenses. Each row gives a row; repeated rows give the same twice; an empty
table none. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.common import need, table

# fixed values: notices and sentences of the licenses' texts
NOTICES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "The person who associated a work with this deed has dedicated the work to the public domain."],
    "EPL-2.0": ["Made available under the terms of the Eclipse Public License 2.0."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "It can be redistributed and modified under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "It can be redistributed and modified under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
}
#: One notice of each license.
TEMPLATES = {name: wordings[0] for name, wordings in NOTICES.items()}
#: What may follow an identifier of the GNU licenses.
_SUFFIXES = ["", "-only", "-or-later"]
HINT = r"(?i)licen[sc]|copyright|redistribut|public\W+domain|permission\W+(is|to)\b"
DIFFERENCES = 2
#: Only words of this kind may differ.
FILLERS = set("a an and are by in is of or released subject terms that the this to under use work licensed".split())
_WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
_SENTENCE = re.compile(r"(?s).*?(?:[.!?](?=\s|\Z)|\n(?=[^\S\n]*\n)|\Z)")
_HINT = re.compile(HINT)


def words(text: str) -> list[str]:
    return [m.group().lower() for m in _WORD.finditer(text)]


def wordings(notices: dict[str, list[str]] = NOTICES) -> list[tuple[str, str]]:
    """License and wording of each template: the notices and the SPDX lines."""
    own = [(name, text) for name, texts in sorted(notices.items()) for text in texts]
    return own + [(name, f"SPDX-License-Identifier: {name}{end}") for name in sorted(notices) for end in (_SUFFIXES if "GPL" in name else [""])]


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words(text)
        self.strict = [w for w in self.words if w not in FILLERS]
        held = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.coder = zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=held)


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] | None = None):
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.templates = [Template(name, text) for name, text in (wordings() if templates is None else templates)]

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Sentences with a license word; a sentence that ends in an abbreviation runs on with the next."""
        start = 0
        for m in _SENTENCE.finditer(text):
            if m.start() == m.end():
                continue
            end = m.end()
            if re.search(r"\b(v|ver|no)\.$", m.group()):
                continue
            if _HINT.search(text, start, end):
                yield start, end
            start = end

    def rank(self, block: str) -> list[Template]:
        """Templates by the bytes that each saves, the most first."""
        raw = block.encode("utf-8", "replace")
        size = len(self.alone.compress(raw))
        saved = [size - len(t.coder.compress(raw)) for t in self.templates]
        return [self.templates[k] for k in sorted(range(len(saved)), key=lambda k: (-saved[k], k))]

    @staticmethod
    def confirmed(found: list[tuple[str, int, int]], t: Template) -> Iterator[tuple[int, int]]:
        """Where the wording stands among found (word, start, end): each time one run, fillers apart equal to the template's."""
        strict, extra = t.strict, len(t.words) - len(t.strict)
        i = 0
        while i < len(found):
            j = skipped = k = 0
            while i + j < len(found) and k < len(strict) and skipped <= DIFFERENCES + extra:
                w = found[i + j][0]
                if w == strict[k]:
                    k += 1
                elif w in FILLERS and (k or w in t.words):
                    skipped += 1
                else:
                    break
                j += 1
            if k == len(strict):
                have = [x[0] for x in found[i : i + j]]
                missing = sum(max(0, t.words.count(w) - have.count(w)) for w in set(t.words) & FILLERS)
                if missing <= DIFFERENCES and len(have) - len(strict) <= extra + DIFFERENCES:
                    yield found[i][1], found[i + j - 1][2]
                    i += j
                    continue
            i += 1

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(license, start, end) in code points, by start."""
        out = []
        for a, b in self.blocks(text):
            block, taken = text[a:b], []
            found = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(block)]
            there = {w for w, _, _ in found}
            for t in self.rank(block):
                if there.issuperset(t.strict):  # else it can't stand here
                    for start, end in self.confirmed(found, t):
                        if all(end <= x or y <= start for _, x, y in taken):
                            taken.append((t.name, start, end))
            out += [(name, a + start, a + end) for name, start, end in sorted(taken, key=lambda x: x[1])]
        return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [[{"license": n, "start": s, "end": e} for n, s, e in scanner.scan(t)] if t else [] for t in batch.column("text").to_pylist()]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, kind)], names=[*names, "licenses"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and licenses: array of (license, start, end)."""
    need(docs, "doc_id", "text")
    hinted = docs.select("doc_id", F.when(F.col("text").rlike(HINT), F.col("text")).alias("text"))  # others aren't sent to Python
    kind = dict(docs.dtypes)["doc_id"]
    return hinted.mapInArrow(_scan, f"doc_id {kind}, licenses array<struct<license:string,start:int,end:int>>")


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.col("licenses.license")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_spans"), F.concat_ws(",", names).alias("licenses"))


ORACLE_SQL = r"""
WITH l AS (SELECT * FROM (VALUES ('Apache-2.0', 'Licensed under the Apache License, Version 2.0'), ('CC-BY-4.0', 'Licensed under CC BY 4.0'), ('CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0'),
  ('CC-BY-SA-4.0', 'Licensed under CC BY-SA 4.0'), ('GPL-2.0', 'licensed under the GNU General Public License, version 2'), ('GPL-3.0', 'licensed under the GNU General Public License, version 3'),
  ('LGPL-3.0', 'licensed under the GNU Lesser General Public License, version 3'), ('MIT', 'Released under the MIT License'), ('MPL-2.0', 'subject to the terms of the Mozilla Public License, v. 2.0')) t(name, wording)),
n AS (SELECT doc_id, name, (length(text) - length(replace(text, wording, ''))) // length(wording) AS n FROM documents, l WHERE contains(text, wording))
SELECT d.doc_id, coalesce(sum(n.n), 0)::BIGINT AS n_spans, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
