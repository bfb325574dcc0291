"""License statements by sparse TF-IDF cosine, and inheritance from the nearest ancestor directory.

A file's own license is the best template match among its lines, paragraphs and header (a statement) and its text
as a whole (a licence file); an SPDX identifier of a known license is taken at its word.  Terms are weighted by
inverse document frequency over all files; words that no template knows count towards a passage's length with
the weight of a term never seen in any file.  A
file without a license takes that of the licence file in its own directory or the nearest one above it: the
distinct directories are joined with their ancestors by path, and files with their directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name, tidy

_TERM = re.compile(r"[a-z0-9]+")

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU_HEAD = "{what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {version}. {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
_GNU = [("GPL-2.0", "GNU General Public License", "2", "version 2, June 1991"), ("GPL-3.0", "GNU General Public License", "3", "Version 3, 29 June 2007"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "Version 2.1, February 1999"), ("LGPL-3.0", "GNU Lesser General Public License", "3", "Version 3, 29 June 2007"), ("AGPL-3.0", "GNU Affero General Public License", "3", "Version 3, 19 November 2007")]

#: Usual statements, headers and whole texts of common licenses.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", _BSD_HEAD),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    *[(i, f"This work is licensed under the {name}, version {v}.") for i, name, v, _ in _GNU],
    *[(i, f"{name} {title}") for i, name, _, title in _GNU],
    *[(i, _GNU_HEAD.format(what="This program", name=name, version=f"either version {v} of the License, or (at your option) any later version")) for i, name, v, _ in _GNU],
]
#: Identifiers that a line may give outright, with what else they may end in.
_SPDX = re.compile(r"spdx-license-identifier:\s*\(?([a-z0-9.+-]+)")
#: Names of licence files.
LICENSE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)(\.[a-z]+)?$"


def terms(text: str | None) -> list[str]:
    return _TERM.findall(text.lower()) if text else []


class Match(NamedTuple):
    license: str | None
    score: float
    line: int | None  # from 0, where a statement starts; null for the text as a whole


_MARKER = re.compile(r"[ \t]*(?:#|//|/?\*|--|;|%|<!--|\"\"\")")


def passages(text: str) -> Iterator[tuple[int, str]]:
    """(first line, text) of what may be a statement: every line, every paragraph of several lines, and the header,
    which is the leading comment."""
    lines = text.split("\n")
    yield from enumerate(lines)
    start: int | None = None
    for i, line in enumerate([*lines, ""]):
        if line.strip(" \t\r#/*;%-"):
            start = i if start is None else start
        elif start is not None:
            if i - start > 1:
                yield start, "\n".join(lines[start:i])
            start = None
    end = next((i for i, line in enumerate(lines) if line.strip() and not _MARKER.match(line)), len(lines))
    if 1 < end < len(lines):
        yield 0, "\n".join(lines[:end])


class Matcher:
    """Templates as unit vectors of (1 + log count) x idf."""

    def __init__(self, templates: list[tuple[str, str]], weights: dict[str, float], unseen: float, threshold: float):
        self.weights, self.unseen, self.threshold = weights, unseen, threshold
        self.templates: list[tuple[str, dict[str, float]]] = []
        self.number = {t: i for i, t in enumerate(sorted({t for _, text in templates for t in terms(text)}))}
        self.squares = np.zeros((len(self.number), len(templates)))
        for k, (name, text) in enumerate(templates):
            v, norm = self.vector(terms(text))
            v = {t: x / norm for t, x in v.items()}
            self.templates.append((name, v))
            for t, x in v.items():
                self.squares[self.number[t], k] = x * x
        self.known = {name.lower(): name for name, _ in templates}

    def vector(self, words: list[str]) -> tuple[dict[str, float], float]:
        v = {t: (1 + math.log(n)) * self.weights.get(t, self.unseen) for t, n in Counter(words).items()}
        return v, math.sqrt(sum(x * x for x in v.values())) or 1.0

    def possible(self, words: set[str], among: np.ndarray | None = None) -> np.ndarray:
        """Templates whose cosine with some of these words can reach the threshold: it is at most the length of what
        the template has in common with them."""
        at = [self.number[t] for t in words if t in self.number]
        mass = self.squares[at].sum(axis=0)
        fits = np.flatnonzero(mass >= self.threshold * self.threshold - 1e-9)
        return fits if among is None else np.intersect1d(fits, among)

    def best(self, words: list[str], among: np.ndarray | None = None) -> tuple[str | None, float]:
        possible = self.possible(set(words), among)
        if not len(possible):
            return None, 0.0
        v, norm = self.vector(words)
        name, score = None, 0.0
        for k in possible:
            other, template = self.templates[k]
            cosine = sum(x * v[t] for t, x in template.items() if t in v) / norm
            if cosine > score + 1e-12:
                name, score = other, cosine
        return (name, min(1.0, score)) if score >= self.threshold else (None, 0.0)

    def scan(self, text: str | None) -> tuple[Match, Match]:
        """The best statement (first of equals) and the whole text."""
        found, whole = Match(None, 0.0, None), Match(None, 0.0, None)
        low = text.lower() if text else ""
        if "spdx-license-identifier" in low:
            for i, line in enumerate(low.split("\n")):
                if (m := _SPDX.search(line)) and (name := self.known.get(re.sub(r"(\+|-only|-or-later)$", "", m[1]))):
                    found = Match(name, 1.0, i)
                    break
        among = self.possible(set(_TERM.findall(low))) if low else ()
        if len(among):
            for i, part in passages(low):
                name, score = self.best(_TERM.findall(part), among)
                if name and score > found.score + 1e-12:
                    found = Match(name, score, i)
            whole = Match(*self.best(_TERM.findall(low), among), None)
        return found, whole


def document_frequencies(files: DataFrame, text_col: str, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and of files that hold each term of the (small, fixed) vocabulary."""

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            total[""] += batch.num_rows
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(vocabulary.intersection(_TERM.findall(text.lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    rows = files.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(tidy(count), "term string, n long").groupBy("term").agg(F.sum("n")).collect()
    found = dict(map(tuple, rows))
    return found.pop("", 0), found


def _with_matches(files: DataFrame, path_col: str, text_col: str, keep: list[str], matcher: Matcher, file_threshold: float) -> DataFrame:
    shared = files.sparkSession.sparkContext.broadcast(matcher)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                line, whole = shared.value.scan(text)
                own = line if line.score >= whole.score else whole
                rows.append((own.license, own.score, own.line, whole.license if whole.score >= file_threshold else None))
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[*keep, "_path", "_own", "_score", "_line", "_whole"])

    chosen = files.select(F.col(f"`{text_col}`").alias(free_name([*keep, "_path"], "_text")), *[F.col(f"`{c}`") for c in keep], F.col(f"`{path_col}`").cast("string").alias("_path"))
    ddl = ", ".join([f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep] + ["_path string, _own string, _score double, _line int, _whole string"])
    return chosen.mapInArrow(tidy(run), ddl)


def scan_licenses(files: DataFrame, *, path_col: str = "path", text_col: str = "text", keep: list[str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = 0.75, file_threshold: float = 0.95) -> DataFrame:
    """``keep`` columns, license, score, line, origin (``statement``, ``file``, ``inherited`` or ``none``) and
    license_dir, the directory inherited from.

    A licence file is one whose whole text is a template (``file_threshold``) or whose name is that of a licence file and
    which has a matching line.  In a directory with several, the best score counts, then the first path.
    A null path has no directory, so nothing is inherited; null and empty texts have no own license.  Of equally
    good templates the first in order counts, of equally good passages the first.  Repeated rows stay repeated.  Empty input: no rows.  What ``keep`` has under the result's
    names is replaced; its names must not start with an underscore.
    """
    keep = [c for c in (keep if keep is not None else [path_col]) if c.lower() not in ("license", "score", "line", "origin", "license_dir")]
    templates = templates if templates is not None else TEMPLATES
    vocabulary = {t for _, text in templates for t in terms(text)}
    total, found = document_frequencies(files, text_col, vocabulary)
    idf = lambda n: math.log((1 + total) / (1 + n)) + 1.0
    matcher = Matcher(templates, {t: idf(found.get(t, 0)) for t in vocabulary}, idf(0), threshold)
    folder = F.when(F.col("_path").contains("/"), F.regexp_replace("_path", "/[^/]*$", "")).when(F.col("_path").isNotNull(), "")
    matched = checkpoint(_with_matches(files, path_col, text_col, keep, matcher, file_threshold).withColumn("_dir", folder))
    named = F.col("_path").rlike(LICENSE_NAMES) & F.col("_own").isNotNull()
    is_file = named | F.col("_whole").isNotNull()
    holders = matched.where(is_file & F.col("_dir").isNotNull()).groupBy("_dir").agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("_path").alias("p"), F.coalesce("_whole", "_own").alias("license"))).alias("b")).select(F.col("_dir").alias("_holder"), F.col("b.license").alias("_inherited"))
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = matched.select("_dir").where(F.col("_dir").isNotNull()).distinct().select("_dir", F.explode(F.array_distinct(above)).alias("_up"))
    nearest = folders.join(holders, F.col("_up") == F.col("_holder")).groupBy("_dir").agg(F.max_by(F.struct("_holder", "_inherited"), F.length("_holder")).alias("_near")).withColumnRenamed("_dir", "_of")
    nearest = checkpoint(nearest)  # so that the join has a plain exchange on either side and a hot folder can be split
    joined = matched.join(nearest, F.col("_dir") == F.col("_of"), "left")
    origin = F.when(F.col("_own").isNotNull(), F.when(is_file, "file").otherwise("statement")).when(F.col("_near").isNotNull(), "inherited").otherwise("none")
    return joined.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("_own", "_near._inherited").alias("license"), F.col("_score").alias("score"), F.col("_line").alias("line"), origin.alias("origin"), F.when(F.col("_own").isNull(), F.col("_near._holder")).alias("license_dir"))
