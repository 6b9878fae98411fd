"""Licence scan: what licence a file states, or else inherits from its directory.

Every line, paragraph and whole text is a sparse vector of its words, weighted by how often they occur there and how
rare they are (document frequencies of the templates' words over all files; any other word counts as the rarest).
So is every run of as many words as a template has, beside that template, for notices inside a line or wrapped over
several. The template with the largest cosine names the licence if it is similar enough, but of templates
that are nearly met those of a higher power of two in words go first. A file that is little more than a
notice, or whose name says so, is its directory's licence file. A file without a notice inherits from the nearest
directory above it that has one; directories are resolved once, by joins on the paths of their ancestors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.tables import extended, slices, stored, text_bytes
from tracelake.llm.words import Lookup, hashes, mix, spans

#: Least cosine of a notice, and least share of a text that makes it its directory's licence file.
SIMILAR, MOSTLY = 0.75, 0.5
#: A run with this cosine meets its template nearly: of such templates the much longer one counts. Words of runs weighed at a time.
MET, RUN_WORDS = 0.9, 1 << 20
LICENSE_NAMES = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$"

_BSD_2 = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
          "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
          "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
          "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
          "with the distribution. ")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
          "products derived from this software without specific prior written permission. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
            "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
            "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
            "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
            "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
            "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_VERBATIM = ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not "
             "allowed.")


def _gnu(program: str, license_: str, version: str) -> str:
    """The header that the GNU licences ask for."""
    return (f"This {program} is free software: you can redistribute it and/or modify it under the terms of the GNU {license_} "
            f"as published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
            f"later version. This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
            f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {license_} "
            "for more details.")


#: Notices as files state them, standard headers, licence files, and of the long licence files the start.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
    ("GPL-2.0", _gnu("program", "General Public License", "2")),
    ("GPL-3.0", _gnu("program", "General Public License", "3")),
    ("LGPL-2.1", _gnu("library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0", _gnu("library", "Lesser General Public License", "3")),
    ("AGPL-3.0", _gnu("program", "Affero General Public License", "3")),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM}"),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("LGPL-2.1", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. {_VERBATIM}"),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
                   "REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
                   "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
                   "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
                   "the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that "
                "creates, contributes to the creation of, or owns Covered Software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
            "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
            "PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
            "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
            "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
            "PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
            "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
            "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
            "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
            "SOFTWARE."),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
]

#: Words are runs of letters and digits; bytes above 127 belong to letters.
SEPARATES = np.ones(256, bool)
SEPARATES[48:58] = SEPARATES[65:91] = SEPARATES[97:123] = SEPARATES[128:] = False


class Templates:
    def __init__(self, texts: list[tuple[str, str]]):
        self.names = [name for name, _ in texts]
        data, offsets = text_bytes(pa.array([text for _, text in texts]))
        starts, ends, first = spans(data, offsets, SEPARATES)
        keys, term = np.unique(hashes(data, starts, ends), return_inverse=True)
        self.lookup, self.terms = Lookup(keys), len(keys)
        row = np.repeat(np.arange(len(texts)), np.diff(first))
        self.lengths = np.diff(first)
        self.order = np.floor(np.log2(self.lengths)).astype(np.int64) + 1
        self.counts = np.bincount(row * self.terms + term, minlength=len(texts) * self.terms).reshape(len(texts), -1)

    def weigh(self, files: int, having: np.ndarray) -> None:
        """Set weights from the number of files and of those that have each term."""
        self.idf = np.append(np.log((files + 1) / (having + 1)) + 1, math.log(files + 1) + 1)
        unit = self.counts * self.idf[:-1]
        self.unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).T

    def cosines(self, term: np.ndarray, word: np.ndarray, segment: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Best template and its cosine for each segment of words."""
        best, value = np.zeros(segments, np.int64), np.zeros(segments)
        if not len(term):
            return best, value
        _, first, n = np.unique(mix(word ^ mix(segment.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
        own = segment[first]
        weight = n * self.idf[term[first]]
        norm = np.sqrt(np.bincount(own, weight ** 2, segments))
        told = np.flatnonzero(term[first] >= 0)
        told = told[np.argsort(own[told], kind="stable")]
        if not len(told):
            return best, value
        at = np.flatnonzero(np.concatenate([[True], own[told][1:] != own[told][:-1]]))
        dots = np.add.reduceat(self.unit[term[first][told]] * weight[told][:, None], at, axis=0)
        rows = own[told][at]
        best[rows] = dots.argmax(axis=1)
        value[rows] = dots.max(axis=1) / norm[rows]
        return best, value


    def runs(self, term: np.ndarray, word: np.ndarray, row: np.ndarray, rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(template, texts, cosines): texts with a run of the template's length that is similar, and the largest cosine.

        Sums over runs give the products and, each word counted by itself, a bound of the norms from below; only runs
        that pass with it are weighed exactly.
        """
        square = self.idf[term] ** 2
        norms = np.concatenate([[0.0], np.cumsum(square)])
        padded = np.vstack([self.unit, np.zeros(self.unit.shape[1])]) * self.idf[:, None]
        for k, n in enumerate(self.lengths.tolist()):
            if len(term) < n:
                continue
            sums = np.concatenate([[0.0], np.cumsum(padded[term, k])])
            dots = sums[n:] - sums[:-n]
            at = np.flatnonzero((row[n - 1:] == row[:len(row) - n + 1])
                                & (dots ** 2 >= (SIMILAR - 1e-9) ** 2 * (norms[n:] - norms[:-n])) & (dots > 0))
            value = np.zeros(rows)
            for some in np.split(at, range(RUN_WORDS // n, len(at), max(1, RUN_WORDS // n))) if len(at) else ():
                places = some[:, None] + np.arange(n)
                by = np.argsort(word[places], axis=1, kind="stable")
                own, weight = np.take_along_axis(word[places], by, 1), np.take_along_axis(square[places], by, 1)
                fresh = np.concatenate([np.ones((len(own), 1), bool), own[:, 1:] != own[:, :-1]], axis=1).ravel()
                starts = np.flatnonzero(fresh)
                many = np.diff(np.append(starts, len(fresh)))
                norm = np.sqrt(np.bincount(starts // n, weight.ravel()[starts] * many ** 2, len(own)))
                np.maximum.at(value, row[some], dots[some] / norm)
            found = np.flatnonzero(value >= SIMILAR)
            if len(found):
                yield k, found, value[found]


def parts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each byte the number of its line, paragraph and text."""
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, offsets[:-1], 1)
    text = np.cumsum(edge[:-1]) - 1
    ends = data == 10
    line = edge.copy()
    line[1:] += ends
    line = np.cumsum(line[:-1] > 0) - 1
    empty = np.zeros(len(data) + 1, bool)
    empty[1:-1] = ends[1:] & ends[:-1]
    paragraph = np.cumsum((edge[:-1] > 0) | np.concatenate([[False], empty[1:-1]])) - 1 if len(data) else text
    return [line, paragraph, text]


def term_counts(files: DataFrame, templates: Templates) -> tuple[int, np.ndarray]:
    """Number of files, and of those that have each of the templates' words."""

    def run(batches):
        total, having = 0, np.zeros(templates.terms, np.int64)
        for batch in batches:
            total += batch.num_rows
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets):
                part, ends = data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]
                starts, stops, first = spans(part, ends, SEPARATES)
                term = templates.lookup(hashes(part, starts, stops))
                row = np.repeat(np.arange(b - a), np.diff(first))[term >= 0]
                having += np.bincount(np.unique(row * templates.terms + term[term >= 0]) % templates.terms,
                                      minlength=templates.terms)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(templates.terms)], pa.int32()),
                                          pa.array([total, *having.tolist()], pa.int64())], ["term", "n"])

    rows = dict(files.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect())
    return rows.get(-1, 0), np.array([rows.get(k, 0) for k in range(templates.terms)], np.int64)


def notices(files: DataFrame, templates: Templates) -> DataFrame:
    """files (key, path, text) without text, with own_license, own_score and own_share (part of the text it covers)."""
    kept = [c for c in files.columns if c != "text"]
    schema = extended(files.select(*kept).schema, {"own_license": "string", "own_score": "double", "own_share": "double"})

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            names, scores, shares = [], [], []
            for a, b in slices(offsets):
                part, ends = data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]
                starts, stops, first = spans(part, ends, SEPARATES)
                word = hashes(part, starts, stops)
                term, row = templates.lookup(word).astype(np.int64), np.repeat(np.arange(b - a), np.diff(first))
                best, value, share = np.zeros(b - a, np.int64), np.zeros(b - a), np.zeros(b - a)
                size = np.diff(first)
                for segment in parts(part, ends) if len(word) else ():
                    own = segment[starts]
                    which, cosine = templates.cosines(term, word, own, int(own[-1]) + 1)
                    words = np.bincount(own)
                    owner = np.zeros(len(words), np.int64)
                    owner[own] = row
                    by = np.lexsort((np.arange(len(cosine)), -cosine, owner))
                    by = by[np.concatenate([[True], owner[by][1:] != owner[by][:-1]])]
                    by = by[cosine[by] > value[owner[by]]]
                    i = owner[by]
                    best[i], value[i], share[i] = which[by], cosine[by], words[by] / size[i]
                met = np.where(value >= MET, templates.order[best], 0)
                for k, i, cosine in templates.runs(term, word, row, b - a):
                    near = np.where(cosine >= MET, templates.order[k], 0)
                    go = (near > met[i]) | ((near == met[i]) & (cosine > value[i] + 1e-9))
                    i, cosine = i[go], cosine[go]
                    best[i], value[i], share[i], met[i] = k, cosine, templates.lengths[k] / size[i], near[go]
                found = value >= SIMILAR
                names += [templates.names[k] if ok else None for k, ok in zip(best.tolist(), found.tolist())]
                scores.append(value)
                shares.append(np.where(found, share, 0.0))
            cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), cat(scores),
                                              cat(shares)], [*kept, "own_license", "own_score", "own_share"])

    return files.mapInArrow(run, schema)


def directory(path: Column) -> Column:
    """What stands before the last slash; empty at the top."""
    return F.regexp_replace(path, "(?s)/?[^/]*$", "")


def inherited(files: DataFrame) -> DataFrame:
    """files (path, own_license, own_score, own_share) with license, license_from and license_directory."""
    rows = files.withColumn("directory", directory(F.col("path")))
    name = F.regexp_replace("path", "(?s)^.*/", "")
    carriers = rows.where(F.col("own_license").isNotNull() & ((F.col("own_share") >= MOSTLY) | F.rlike(name, F.lit(LICENSE_NAMES))))
    licensed = carriers.groupBy("directory").agg(
        F.min_by("own_license", F.struct(-F.col("own_score"), "path", "own_license")).alias("license"))
    steps = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("above")))
    asked = (rows.where("own_license IS NULL").select("directory").distinct()
             .select("directory", F.explode(above).alias("x")).select("directory", "x.depth", "x.above").distinct())
    resolved = (asked.join(licensed.withColumnRenamed("directory", "above"), "above").groupBy("directory")
                .agg(F.max_by(F.struct("license", "above"), "depth").alias("found")))
    return (rows.join(resolved, "directory", "left")
            .withColumn("license_from", F.when(F.col("own_license").isNotNull(), "own")
                        .when(F.col("found").isNotNull(), "inherited"))
            .withColumn("license", F.coalesce("own_license", "found.license"))
            .withColumn("license_directory", F.when(F.col("own_license").isNull(), F.col("found.above")))
            .drop("found", "directory"))


def licenses(files: DataFrame, texts: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Licence of every file.

    files: path string, text string; further columns are kept, those named as results are replaced. Adds own_license, own_score
    (cosine with the template that counts), own_share (part of the words that the notice covers), license, license_from
    (`own`, `inherited` or null) and license_directory (whence it is inherited; empty for the top). A null or empty
    text states nothing; a null path states what its text does, inherits nothing and passes nothing on. Of several
    licence files in a directory the most similar counts, then the first by path. Repeated rows give equal rows;
    an empty table gives an empty result.
    """
    added = ("own_license", "own_score", "own_share", "license", "license_from", "license_directory", "directory", "found")
    files = files.drop(*added)
    templates = Templates(texts)
    templates.weigh(*term_counts(files, templates))
    found = stored(notices(files, templates))
    placed, loose = found.where("path IS NOT NULL"), found.where("path IS NULL")
    extra = {"license": F.col("own_license"), "license_from": F.when(F.col("own_license").isNotNull(), "own"),
             "license_directory": F.lit(None).cast("string")}
    return inherited(placed).unionByName(loose.withColumns(extra))
