"""License scans by conditional compression.

Words that licenses use are triggers.  Around each, the words that a template
could reach are compressed alone and with the template as a raw zstandard
dictionary; where enough is saved, the exact wording confirms: the template's
words must be there, in order, up to a small difference that leaves alone the
words that tell versions apart; the words that differ are reported.  Windows are counted
in words, so neither line breaks nor white space nor a text's length matter.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wordings of licenses, as they are found in texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-short": "Released under the MIT License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
TRIGGER = re.compile(rb"(?i)licen[cs]|copyright|permission|redistribut|public domain|spdx|warrant|free software")
TRIGGER_SQL = r"(?i)licen[cs]|copyright|permission|redistribut|public domain|spdx|warrant|free software"
MIN_SAVING = 0.25  # of the block's own compressed size, or of the template's, whichever is smaller
MAX_DIFFERENCE = 0.1  # words of the template that may be missing or in other order
REACH = 2  # a template's words are looked for in a stretch of so many times their number
TELLING = re.compile(rb"[0-9]|^general$")  # words of a template that tell it from its other versions, or from the Lesser and Affero GPL
_WORD = re.compile(rb"[0-9a-z]+(?:[.\-][0-9a-z]+)*")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.templates = {name: words_of(text.encode()) for name, text in templates.items()}
        self.telling = {name: [i for i, w in enumerate(words) if TELLING.search(w)] for name, words in self.templates.items()}
        self.reach = REACH * max(map(len, self.templates.values()), default=0)
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given, self.alone = {}, {}
        for name, words in self.templates.items():
            text = b" ".join(words)
            data = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[name] = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_dict_id=False)
            self.alone[name] = len(self.plain.compress(text))

    def windows(self, text: bytes) -> Iterator[tuple[list[bytes], int]]:
        """The words around each word with a trigger, as far as the longest template reaches, and that word's place in them."""
        text = text.lower()
        starts = np.fromiter((m.start() for m in _WORD.finditer(text)), dtype=np.int64)
        places = np.fromiter((m.start() for m in TRIGGER.finditer(text)), dtype=np.int64)
        for i in np.unique(np.searchsorted(starts, places, side="right") - 1).tolist():
            a, b = max(0, i - self.reach), i + self.reach + 1
            yield words_of(text[starts[a] : starts[b] if b < len(starts) else len(text)]), i - a

    def rank(self, words: list[bytes], at: int) -> list[tuple[float, str, list[bytes]]]:
        """Templates by the share of the compressed size that they save, with the words that they reach around a place."""
        have = set(words)
        found = []
        for name, want in self.templates.items():
            if sum(w in have for w in want) < (1 - MAX_DIFFERENCE) * len(want) - 1e-9:
                continue  # too many words are nowhere near
            near = words[max(0, at - REACH * len(want)) : at + REACH * len(want) + 1]
            block = b" ".join(near)
            own = len(self.plain.compress(block))
            saving = (own - len(self.given[name].compress(block))) / min(own, self.alone[name])
            if saving >= MIN_SAVING:
                found.append((saving, name, near))
        return sorted(found, key=lambda x: (-x[0], x[1]))

    def difference(self, name: str, words: list[bytes]) -> tuple[float, list[bytes], list[bytes]]:
        """Share of the template's words that the words don't have in their order; those words; and the words that stand among the others instead."""
        want = self.templates[name]
        match = difflib.SequenceMatcher(None, want, words, autojunk=False)
        # near one another: the matching blocks inside the densest stretch
        blocks = [b for b in match.get_matching_blocks() if b.size]
        best, size = [], 0
        for i, first in enumerate(blocks):
            reach = first.b + REACH * len(want)
            kept = [b for b in blocks[i:] if b.b + b.size <= reach]
            if self.told(name, kept) and sum(b.size for b in kept) > size:
                best, size = kept, sum(b.size for b in kept)
        have, used = {b.a + j for b in best for j in range(b.size)}, {b.b + j for b in best for j in range(b.size)}
        added = [words[j] for j in range(best[0].b, best[-1].b + best[-1].size) if j not in used] if best else []
        return 1 - size / len(want), [w for i, w in enumerate(want) if i not in have], added

    def told(self, name: str, blocks: list) -> bool:
        """Whether the words that tell versions apart are matched, no further behind the match before them than in the template."""
        place = {b.a + j: b.b + j for b in blocks for j in range(b.size)}
        for i in self.telling[name]:
            before = next((j for j in range(i - 1, -1, -1) if j in place), None)
            if i not in place or before is not None and place[i] - place[before] > i - before:
                return False
        return True

    def least_difference(self, name: str, words: list[bytes]) -> tuple[float, list[bytes], list[bytes]]:
        """The difference; where it is too large, the least one of single stretches, lest a like wording beside it hides a license."""
        gap, n = self.difference(name, words), len(self.templates[name])
        if gap[0] > MAX_DIFFERENCE:
            gap = min([gap, *(self.difference(name, words[a : a + REACH * n]) for a in range(0, max(1, len(words) - n + 1), max(1, n // 4)))])
        return gap

    def scan(self, text: bytes) -> list[tuple[str, float, float, str, str]]:
        """(license, saving, difference, missing words, added words) of the licenses that the text states, each where it differs least (then saves most, then first)."""
        found: dict[str, tuple] = {}
        for words, at in self.windows(text):
            for saving, name, near in self.rank(words, at):
                gap, missing, added = self.least_difference(name, near)
                old = found.get(name, (0, 2))
                if gap <= MAX_DIFFERENCE and (gap, -saving) < (old[1], -old[0]):
                    found[name] = (saving, gap, b" ".join(missing).decode(), b" ".join(added).decode())
        return [(name, *x) for name, x in sorted(found.items())]


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                hits = scanner.scan(text) if text and TRIGGER.search(text) else []
                columns[0].append(len(hits))
                for i in range(5):
                    columns[i + 1].append([round(x[i], 6) if i in (1, 2) else x[i] for x in hits])
            texts, numbers = pa.list_(pa.string()), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), texts, numbers, numbers, texts, texts), strict=True))], names=["id", "n_licenses", "licenses", "savings", "differences", "missing", "added"])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row for each row of docs: id, n_licenses, licenses (names in order), savings, differences, missing, added.

    missing: the template's words that the text lacks there; added: the words
    that stand among the matched ones instead, each with spaces between.  Of
    several places for one license, the one that differs least counts.  Texts
    without a license word go to Python as null (the test is made in the JVM).
    Null and empty texts have no licenses; rows that repeat are reported as
    often; other columns, of any name, are not read; no rows give no rows.
    Nothing is shuffled.
    """
    text = F.col(f"`{text_col}`").cast("string")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(text.rlike(TRIGGER_SQL), text).alias("text"))
    out = source.mapInArrow(_scan(templates), "id long, n_licenses long, licenses array<string>, savings array<double>, differences array<double>, missing array<string>, added array<string>")
    return out.withColumnRenamed("id", id_col)
