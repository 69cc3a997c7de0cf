"""Operator 4: license scans by conditional compression, confirmed by exact wording."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline.llm.common import small_batches, table
from pitchline.llm.registry import register

#: Public wordings of license notices. A parameter; full license texts can be given in the same form.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                    "the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                      "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                         "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
                         "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
                         "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
                         "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
                         "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
                         "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
                         "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
                         "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
                         "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
                         "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
                "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
                "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
                "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
                "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
                "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
                "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
                "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
                "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
                "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
                "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
                "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: A block is what stands around one of these; every template holds one, which ``scan`` checks.
MARKERS = r"(?i)licen[sc]e|redistribut|permission is|copyright|spdx"
LEVEL = 3
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def _tokens(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Scanner:
    """Compressors with each template as a raw dictionary. Texts are compared as their words in lower case, one space apart."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.words = {n: _tokens(templates[n]) for n in self.names}
        texts = {n: " ".join(w) for n, w in self.words.items()}
        self.reach = {n: len(t) for n, t in texts.items()}
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = {n: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
            t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n, t in texts.items()}

    def rank(self, text: str, at: int) -> list[tuple[float, str, int, str]]:
        """(saved, name, place of the passage, passage), largest saving first (ties by name), where the passage is as much of the text to
        either side of the marker at ``at`` as the template is long and ``saved`` the share of its compressed size that the template saves."""
        out = []
        for name, compressor in self.given.items():
            low = max(0, at - self.reach[name])
            passage = text[low:at + self.reach[name]]
            data = passage.encode("utf-8", "surrogatepass")
            out.append((1 - len(compressor.compress(data)) / len(self.plain.compress(data)), name, low, passage))
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def wording(self, passage: str, name: str) -> tuple[int, int, int, list[str]]:
        """How many of the template's words stand in the passage in order, the stretch of words they take up, and the differences in it."""
        want, have = self.words[name], passage.split(" ")
        runs = [m for m in SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if m.size]
        if not runs:
            return 0, 0, 0, [f"-{w}" for w in want]
        low = max(0, runs[0].b - runs[0].a)             # words that stand for missing first or last ones belong to the stretch
        high = min(len(have), runs[-1].b + len(want) - runs[-1].a)
        differences = []
        for op, a, b, c, d in SequenceMatcher(None, want, have[low:high], autojunk=False).get_opcodes():
            if op != "equal":
                differences += [f"-{w}" for w in want[a:b]] + [f"+{w}" for w in have[low + c:low + d]]
        return sum(m.size for m in runs), low, high, differences

    def notices(self, text: str, least_saved: float, least_wording: float) -> list[tuple]:
        """(first word, one past the last, license, saved, runner-up, wording, differences) of the notices in a text of words one space apart.

        Every template that saves enough at a marker is compared word by word. Of notices that overlap the one with the most words stays
        (then the better wording, the larger saving, the first name).
        """
        found, done = [], -1
        for marker in re.finditer(MARKERS, text):
            if marker.start() < done:                  # inside the longest notice of an earlier marker
                continue
            ranked = self.rank(text, marker.start())
            for place, (saved, name, at, passage) in enumerate(ranked):
                if saved < least_saved:
                    break
                if len(passage) < least_wording * self.reach[name] * 0.5:
                    continue
                met, low, high, differences = self.wording(passage, name)
                share = met / len(self.words[name])
                if share >= least_wording:
                    first = text.count(" ", 0, at) + low
                    other = ranked[place + 1][1] if place + 1 < len(ranked) else None
                    found.append((met, share, saved, name, first, first + high - low, other, differences))
                    done = max(done, at + len(" ".join(passage.split(" ")[:high])))
        out: list[tuple] = []
        for met, share, saved, name, first, last, other, differences in sorted(found, key=lambda f: (-f[0], -f[1], -f[2], f[3], f[4])):
            if all(last <= o[0] or first >= o[1] for o in out):
                out.append((first, last, name, saved, other, share, differences))
        return sorted(out)


_SCHEMA = "doc_id long, block_no int, last_line int, license string, saved double, runner_up string, wording double, differences array<string>, exact boolean"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least_saved: float = 0.2, least_wording: float = 0.8) -> DataFrame:
    """One row per license notice: ``doc_id``, ``block_no`` and ``last_line`` (0-based lines in which it begins and ends), ``license``,
    ``saved`` (share of the compressed size the template saves), ``runner_up`` (template ranked next), ``wording`` (share of the template's
    words present in order), ``differences`` (words missing with -, words added within with +) and ``exact``.

    Texts with a marker are found by the JVM; only they reach Python, where a block is what stands around a marker: as many
    characters of words to either side as the template has, across line ends, comment signs and punctuation. Templates are ranked by
    what they save as raw dictionary; every one that saves ``least_saved`` and has ``least_wording`` of its words in the block in order is
    confirmed. Of overlapping notices the one with the most words is reported; ties go to better wording, saving and then name.

    Rows are handled where they are read and there is no shuffle. Null and empty texts give no row, repeated notices and
    rows a row each, null ids are kept, other columns are ignored; memory follows one text. In a very long text each marker outside the
    notices found so far costs one compression per template.
    """
    templates = TEMPLATES if templates is None else templates
    missing = [n for n, t in templates.items() if not re.search(MARKERS, t)]
    if missing:
        raise ValueError(f"templates without a marker word: {missing}")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_()]
        names = ["doc_id", "block_no", "last_line", "license", "saved", "runner_up", "wording", "differences", "exact"]
        for batch in batches:
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = list(_WORD.finditer(text))
                for first, last, *rest in scanner.notices(" ".join(w.group().lower() for w in words), least_saved, least_wording):
                    lines = (text.count("\n", 0, words[first].start()), text.count("\n", 0, words[last - 1].start()))
                    out.append((doc_id, *lines, *rest, not rest[-1]))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).filter(F.col("text").rlike(MARKERS))
    return marked.mapInArrow(run, _SCHEMA)


@register("op4_license_compression")
def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
