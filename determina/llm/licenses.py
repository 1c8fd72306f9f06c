"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory above.

Lines, paragraphs, whole texts and all windows of a template's length (across lines and inside long
ones) are compared with the templates, licence texts and headers, as sparse TF-IDF vectors. Sums
along the text bound every cosine from above, so only spans that may reach the threshold are
compared. Document frequencies
of the templates' words are counted over all texts; words that no template has weigh like words of
a single text. A file whose words are mostly licence lines, or that is named like one, is a licence
file and speaks for its directory; files without a licence of their own take that of the nearest
directory above that has one.
"""

from __future__ import annotations

from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from determina.llm.shared import ALNUM, LOWER, Hasher, chunks, tokens

#: Licences and texts that declare them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
     compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
     Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
     an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
     specific language governing permissions and limitations under the License."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
     that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
     list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
     notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
     the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
     or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY
     THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
     THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
     COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
     DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
     BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
     (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
     POSSIBILITY OF SUCH DAMAGE."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
     Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
     later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
     the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
     more details."""),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
     rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
     persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
     this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
     "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
     MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
     HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
     ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
     not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    *((name, files("determina.llm").joinpath(f"license_texts/{name}.txt").read_text()) for name in ("Apache-2.0", "GPL-3.0", "MPL-2.0")),
]
#: Tokens of spans compared at once. Shorter templates are titles, which stand on lines of their own.
AT_ONCE, TITLE = 1 << 20, 5
NAMES = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"


def words_of(text: str) -> list[bytes]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = tokens(data, np.array([0, len(data)]), ALNUM)
    return [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


class Templates:
    """Unit vectors of the templates over their own words, by digest."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[int, int], texts: int) -> None:
        hasher, bags = Hasher(), []
        for _, text in templates:
            data = LOWER[np.frombuffer(text.encode(), np.uint8)]
            starts, ends, _ = tokens(data, np.array([0, len(data)]), ALNUM)
            bags.append(hasher.load(data).spans(starts, ends))
        self.names = [name for name, _ in templates]
        self.sizes = [len(b) for b in bags]
        self.words = np.unique(np.concatenate(bags))
        self.weight = np.array([np.log((texts + 2) / (frequency.get(int(w.view(np.int64)), 0) + 1)) for w in self.words])
        self.rare = float(np.log(texts + 2))
        table = np.stack([np.bincount(np.searchsorted(self.words, b), minlength=len(self.words)) * self.weight for b in bags])
        self.unit = table / np.linalg.norm(table, axis=1, keepdims=True)


def _tokenised(batch: pa.RecordBatch, hasher: Hasher):
    for lo, hi, raw, offsets in chunks(batch.column("text")):
        data = LOWER[raw]
        starts, ends, first = tokens(data, offsets, ALNUM)
        yield lo, hi, data, offsets, starts, ends, first, hasher.load(data).spans(starts, ends)


def _frequency_batches(words: np.ndarray):
    """Task code: (text) to (word, n): in how many texts of the batch each template word is."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo, hi, _, _, starts, _, first, hashes in _tokenised(batch, hasher):
                at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
                hit = np.flatnonzero(words[at] == hashes)
                doc = np.searchsorted(first, hit, "right") - 1
                pairs = np.unique(doc * len(words) + at[hit])
                n = np.bincount(pairs % len(words), minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    return run


def _spans(t: Templates, line: np.ndarray, first: np.ndarray, dots: list[np.ndarray], squares: np.ndarray, least: float):
    """First and last (exclusive) words of the spans whose cosine may reach ``least``.

    ``dots`` are running sums of each template's products, ``squares`` those of the squared weights.
    A word that a span repeats adds more to its squared norm than its sum of squares, so the bound
    holds. Windows of long templates move by a 64th of their length.
    """
    n = len(line)
    lines = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1], [True])))
    doc = np.searchsorted(first, np.arange(n), "right") - 1
    paragraphs = np.flatnonzero(np.concatenate(([True], (line[1:] > line[:-1] + 1) | (doc[1:] != doc[:-1]), [True])))
    texts = np.unique(first)
    a, b = (np.concatenate([x[k : len(x) - 1 + k] for x in (lines, paragraphs, texts)]) for k in (0, 1))
    low = least * np.sqrt(squares[b] - squares[a]) - 1e-6
    may = np.zeros(len(a), bool)
    found = []
    for k, size in enumerate(t.sizes):
        may |= dots[k][b] - dots[k][a] >= low
        if size < TITLE or size > n:
            continue
        at = np.arange(0, n - size + 1, 1 + size // 64)
        at = at[dots[k][at + size] - dots[k][at] >= least * np.sqrt(squares[at + size] - squares[at]) - 1e-6]
        at = at[doc[at] == doc[at + size - 1]]
        found.append(np.stack([at, at + size], 1))
    return np.unique(np.concatenate([np.stack([a[may], b[may]], 1), *found]), axis=0)


def _cosines(t: Templates, spans: np.ndarray, ids: np.ndarray, weight: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Cosines of all spans to all templates; ``weight`` and ``unit`` are those of the word numbers ``ids``."""
    out, size = np.zeros((len(spans), len(t.names))), spans[:, 1] - spans[:, 0]
    group = np.cumsum(size) // AT_ONCE
    for lo, hi in zip(*(np.searchsorted(group, np.unique(group), side) for side in ("left", "right")), strict=True):
        own, m = size[lo:hi], hi - lo
        place = np.repeat(spans[lo:hi, 0] - np.cumsum(own) + own, own) + np.arange(own.sum())
        pair, n = np.unique(np.repeat(np.arange(m), own) * len(weight) + ids[place], return_counts=True)
        row, word = pair // len(weight), pair % len(weight)
        value = n * weight[word]
        norm = np.sqrt(np.maximum(np.bincount(row, value**2, m), 1e-300))
        for k in range(len(t.names)):
            out[lo:hi, k] = np.bincount(row, value * unit[k, word], m) / norm
    return out


def _scan_batches(t: Templates, least: float):
    """Task code: (row, text) to (row, license, score, n_words, n_license_words, found)."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo, hi, data, offsets, starts, ends, first, hashes in _tokenised(batch, hasher):
                found: list[dict[str, float]] = [{} for _ in range(hi - lo)]
                declared = np.zeros(hi - lo, np.int64)
                if len(starts):
                    # A line ends at a line feed or at the end of its text.
                    line = np.searchsorted(np.union1d(np.flatnonzero(data == 10) + 1, offsets), starts, "right") - 1
                    distinct, ids = np.unique(hashes, return_inverse=True)
                    at = np.minimum(np.searchsorted(t.words, distinct), len(t.words) - 1)
                    known = t.words[at] == distinct
                    # Other words are each as rare as can be.
                    weight = np.where(known, t.weight[at], t.rare)
                    unit = np.where(known, t.unit[:, at], 0.0)
                    dots = [np.concatenate(([0.0], np.cumsum((weight * unit[k])[ids]))) for k in range(len(t.names))]
                    spans = _spans(t, line, first, dots, np.concatenate(([0.0], np.cumsum((weight**2)[ids]))), least)
                    cosine = _cosines(t, spans, ids, weight, unit)
                    best = cosine.argmax(1) if len(spans) else np.zeros(0, int)
                    top = cosine[np.arange(len(spans)), best]
                    doc_of = np.searchsorted(first, spans[:, 0], "right") - 1
                    # Of spans that overlap the best one speaks, of equal ones the longest.
                    taken, hits = np.zeros(len(starts), bool), np.flatnonzero(top >= least)
                    for k in hits[np.lexsort((spans[hits, 0] - spans[hits, 1], -np.round(top[hits], 9)))]:
                        own = taken[spans[k, 0] : spans[k, 1]]
                        if own.any():
                            continue
                        own[:] = True
                        name, d = t.names[best[k]], doc_of[k]
                        found[d][name] = max(found[d].get(name, 0.0), min(1.0, float(top[k])))
                    covered = np.concatenate(([0], np.cumsum(taken)))
                    declared = covered[first[1:]] - covered[first[:-1]]
                first_choice = [min(f.items(), key=lambda x: (-x[1], x[0])) if f else (None, 0.0) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, hi - lo), pa.array([x[0] for x in first_choice], pa.string()), pa.array([x[1] for x in first_choice], pa.float64()),
                     pa.array(np.diff(first).astype(np.int64)), pa.array(declared), pa.array([sorted(f) for f in found], pa.list_(pa.string()))],
                    ["row", "license", "score", "n_words", "n_license_words", "found"])

    return run


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """(row, license, score, n_words, n_license_words, found) of every row.

    ``license`` is the template of the best span with a cosine of ``least`` or more (of equal ones
    the first by name), ``found`` all licences declared. Null or empty texts declare nothing.
    Repeated rows get the same answer; an empty table is empty.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    words = Templates(templates, {}, 1).words
    counted = rows.select("text").mapInArrow(_frequency_batches(words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = {r.word: r.n for r in counted.collect()}
    t = Templates(templates, frequency, rows.count())
    added = StructType.fromDDL("license string, score double, n_words long, n_license_words long, found array<string>")
    return rows.mapInArrow(_scan_batches(t, least), StructType(rows.schema.fields[:1] + added.fields))


def inherit(scanned: DataFrame, path: Column, share: float = 0.5) -> DataFrame:
    """``scanned`` with path, is_license_file, effective, origin (own, inherited, none) and from_dir.

    A directory's licence is that of its licence files (the best score, then the name). Each distinct
    directory is joined to the directories above it by path, so a directory with very many files is
    one row until its licence is known. A null path is in no directory and inherits nothing.
    """
    named = scanned.withColumn("path", path)
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    many = (F.col("n_license_words") > 0) & (F.col("n_license_words") >= share * F.col("n_words"))
    named = named.withColumn("is_license_file", F.col("license").isNotNull() & (many | F.coalesce(base.rlike(NAMES), F.lit(False))))
    named = named.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    given = named.where("is_license_file and dir is not null").groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    parts = F.split("dir", "/")
    dirs = named.where("dir is not null").select("dir").distinct().select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    dirs = dirs.select("dir", "depth", F.array_join(F.slice(parts, 1, F.col("depth")), "/").alias("above")).where("depth > 0 or dir != ''")
    nearest = dirs.join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", F.col("best.license").alias("license"))).alias("near"))
    out = named.join(nearest, "dir", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select(*scanned.columns, "path", "is_license_file", F.coalesce("license", "near.license").alias("effective"), origin.alias("origin"),
                      F.when(F.col("license").isNull(), F.col("near.above")).alias("from_dir"))
