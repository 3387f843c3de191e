"""Licence scan: sparse TF-IDF cosine to notice templates, then inheritance from ancestor directories.

Terms are words with their ASCII punctuation left out of the hash, A-Z lower-cased; words of nothing else (comment
marks) are no terms. The weight of a term is its count times log((N + 1) / (d + 0.5)) with d of the N files holding it,
over all files (a term outside the templates counts as in none). Templates are whole licences, headers and notices.
Compared with each template are every line of a file and every stretch of the template's number of terms, over line
ends, or the whole file where it is shorter; so headers and licence files count however they are wrapped. A bound of
the cosine, from running sums over many files at once, leaves few to be worked out in full, and leaves out none that
reaches `least`. The best one at `least` or more is the file's own licence; without one, similarity is null.
Licence files (by name) give theirs to their directory; a file without an own licence takes that of its nearest
ancestor directory that has one.

Null texts are empty; files without a path keep their own licence and inherit none. Rows that repeat are
each judged; of several licence files in a directory the most similar counts (ties: the smallest name), and of
templates that are equally similar the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .storage import BROADCAST_KEYS, materialize, prepare, sized

# Licences, headers and notices in their usual wording.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0"),
    ("MIT", f"MIT License {_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_AS_IS}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA {_VERBATIM}"),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
SHARES = 64
FILE_NAME = r"(?i)^(licen[sc]e|copying|notice)([.\-].*)?$"
_CODE = K._WORD_CODE.copy()
_CODE[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0


def _terms(words: K.Words) -> np.ndarray:
    """A hash for each word; 0 for one of nothing but punctuation. A long text is worked on in parts."""
    out = np.zeros(len(words.start), np.uint64)
    at = 0
    while at < len(out):
        lo = int(words.start[at])
        end = max(at + 1, int(np.searchsorted(words.end, lo + K.CHUNK, "right")))
        start, stop = words.start[at:end] - lo, words.end[at:end] - lo
        data = words.data[lo : lo + int(stop[-1])]
        up, down = K._powers(len(data))
        h = np.add.reduceat(_CODE[data] * up[: len(data)], start)
        lead = start.copy()
        while True:  # leading punctuation shifts the powers
            skip = (lead < stop - 1) & (_CODE[data[lead]] == 0)
            if not skip.any():
                break
            lead += skip
        out[at:end] = np.where(h == 0, 0, K.mix(h * down[lead]))
        at = end
    return out


def _all_terms(texts: list[str]):
    for _, _, words in K.texts(pa.array(texts, pa.string())):
        h = _terms(words)
        for i in range(len(words.off) - 1):
            mine = h[words.off[i] : words.off[i + 1]]
            yield mine[mine != 0]


class Templates:
    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        self.terms = list(_all_terms([t for _, t in templates]))
        self.known = np.unique(np.concatenate(self.terms))

    def weigh(self, files: int, holding: np.ndarray) -> Templates:
        """holding: for each known term the files that hold it."""
        self.idf = np.log((files + 1) / (np.minimum(holding, files) + 0.5))
        self.other = float(np.log((files + 1) / 0.5))
        rows = [self.vector(t)[0] for t in self.terms]
        self.matrix = np.stack([r / max(1e-12, np.linalg.norm(r)) for r in rows])
        return self

    def vector(self, terms: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights of the known terms, and the length of the whole vector."""
        key, n = np.unique(terms, return_counts=True)
        at = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
        hit = self.known[at] == key
        out = np.zeros(len(self.known))
        out[at[hit]] = n[hit] * self.idf[at[hit]]
        return out, float(np.sqrt((out**2).sum() + ((n[~hit] * self.other) ** 2).sum()))

    def cosine(self, t: int, terms: np.ndarray) -> float:
        row, length = self.vector(terms)
        return float(self.matrix[t] @ row / max(1e-12, length))

    def best(self, terms: np.ndarray, text: np.ndarray, line: np.ndarray, n_texts: int, least: float) -> list[tuple[float, int]]:
        """terms of many texts in a row, each with the number of its text and line -> for each text (cosine, template) of its best
        line or stretch, or (0, -1) where none reaches `least`."""
        out = [(0.0, -1)] * n_texts
        if not len(terms):
            return out
        at = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        hit = self.known[at] == terms
        weight = np.where(hit, self.idf[at], self.other)
        squares = np.concatenate(([0.0], np.cumsum(weight**2)))
        new = np.flatnonzero(np.append(True, (np.diff(line) != 0) | (np.diff(text) != 0)))
        bounds = np.append(np.flatnonzero(np.append(True, np.diff(text) != 0)), len(terms))
        size = np.repeat(np.diff(bounds), np.diff(bounds))
        found = []
        for t, mine in enumerate(self.terms):
            n = len(mine)
            products = np.concatenate(([0.0], np.cumsum(np.where(hit, weight * self.matrix[t][at], 0.0))))
            # whole lines; stretches of n terms, where a text has as many; else the text
            wide = np.flatnonzero(size[: len(terms) - n + 1] >= n) if len(terms) >= n else new[:0]
            lo = np.concatenate((new, wide, bounds[:-1][np.diff(bounds) < n]))
            hi = np.concatenate((new[1:], [len(terms)], wide + n, bounds[1:][np.diff(bounds) < n]))
            same = text[lo] == text[hi - 1]
            lo, hi = lo[same], hi[same]
            # Repeated terms make a stretch longer than the root of its squares, so the cosine is at most the bound.
            bound = (products[hi] - products[lo]) / np.sqrt(np.maximum(1e-12, squares[hi] - squares[lo])) + 1e-9
            near = np.flatnonzero(bound >= least)
            found += zip((-bound[near]).tolist(), [t] * len(near), lo[near].tolist(), hi[near].tolist(), text[lo[near]].tolist(), strict=True)
        for bound, t, lo, hi, i in sorted(found):
            if -bound < out[i][0]:
                continue
            c = self.cosine(t, terms[lo:hi])
            if c >= least and (c > out[i][0] or c == out[i][0] and t < out[i][1]):
                out[i] = (c, t)
        return out


def _holding(shared):
    def run(batches):
        known = shared.value.known
        total, files = np.zeros(len(known), np.int64), 0
        for b in batches:
            for lo, hi, words in K.texts(b.column("text")):
                h = _terms(words)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                owner = np.repeat(np.arange(hi - lo), np.diff(words.off))
                pairs = np.unique(owner[hit] * len(known) + at[hit])
                total += np.bincount(pairs % len(known), minlength=len(known))
                files += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(known))], pa.int32()), pa.array([files, *total.tolist()], pa.int64())], ["term", "n"])

    return run


def _own(shared, least):
    def run(batches):
        t = shared.value
        for b in batches:
            found = []
            for lo, hi, words in K.texts(b.column("text")):
                terms = _terms(words)
                real = terms != 0
                text = np.repeat(np.arange(hi - lo), np.diff(words.off))
                line = np.searchsorted(np.flatnonzero(words.data == 10), words.start)
                found += t.best(terms[real], text[real], line[real], hi - lo, least)
            names = [t.names[i] if i >= 0 else None for _, i in found]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("path"), pa.array(names, pa.string()), pa.array([c if i >= 0 else None for c, i in found], pa.float64())], ["id", "path", "license", "similarity"])

    return run


def scan_licenses(files: DataFrame, least: float = 0.7, templates=TEMPLATES) -> DataFrame:
    """files(id, path, text) -> id, path, license, similarity, origin (own, inherited or null), license_path."""
    spark = files.sparkSession
    prepare(spark)
    rows = files.select(F.col("id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string"))
    t = Templates(templates)
    held = rows.select("text").mapInArrow(_holding(spark.sparkContext.broadcast(t)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r.term: r.n for r in held}
    t.weigh(n.get(-1, 0), np.array([n.get(i, 0) for i in range(len(t.known))]))
    shared = spark.sparkContext.broadcast(t)
    own = materialize(rows.mapInArrow(_own(shared, least), "id long, path string, license string, similarity double"), "own")
    name, folder = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_replace("path", r"/?[^/]*$", "")
    given = own.where(F.col("license").isNotNull() & F.col("path").isNotNull() & name.rlike(FILE_NAME)).groupBy(folder.alias("dir"))
    given = materialize(given.agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "license")).alias("l")).select("dir", F.col("l.license").alias("license"), F.col("l.path").alias("license_path")), "given")
    # Each folder's nearest ancestor (or itself) with a licence: folders, not files, are joined by path.
    folders = own.where("license is null and path is not null").select(folder.alias("folder")).distinct()
    parts = F.split("folder", "/")
    ups = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    n_given = given.count()
    pairs = folders.withColumn("dir", F.explode(F.array_distinct(ups)))
    if n_given <= BROADCAST_KEYS:
        near = pairs.join(F.broadcast(given), "dir")
    else:  # all folders lie below the top ones: their pairs are dealt out in shares
        share = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
        near = pairs.withColumn("share", F.pmod(F.xxhash64("folder"), F.lit(SHARES)).cast("int")).join(given.select("*", share), ["dir", "share"])
    near = near.groupBy("folder").agg(F.max(F.struct(F.length("dir").alias("n"), "license", "license_path")).alias("l")).select("folder", F.col("l.license").alias("up"), F.col("l.license_path").alias("up_path"))
    near = materialize(near, "near")
    out = own.withColumn("folder", F.when(F.col("license").isNull(), folder)).join(sized(near, 4 * near.count()), "folder", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited")
    return out.select("id", "path", F.coalesce("license", "up").alias("license"), F.round("similarity", 9).alias("similarity"), origin.alias("origin"), F.when(origin == "own", F.col("path")).otherwise(F.col("up_path")).alias("license_path"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: folders by source, thousands and hundreds of doc_id; the first of each hundred is the folder's licence file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.when(F.col("doc_id") % 100 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), name)
    return scan_licenses(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")).withColumnRenamed("id", "doc_id")
