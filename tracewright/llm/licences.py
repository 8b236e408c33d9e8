"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance down the directories.

Templates are whole licence texts, standard headers and notices, and titles. Units of a text are its lines, its
paragraphs, the whole text (a licence file), and for each cue (see below) the terms around it that would be the template
if the cue is the template's: as many before and behind as the template has, whatever the lines, so that a header after a
notice or inside a sentence, or a licence text inside a longer file, is a unit of its own. A unit's terms weigh their
number times log(1 + N / (1 + documents with the term)), both counted over all documents; a term of no template has the
greatest weight. The unit nearest to a template, at a cosine of ``LEAST`` or more, gives the document's own licence; of
units as near the longer template counts. An SPDX line with an identifier of the templates (the first one of an
expression) names it outright, with score 1.

A line or paragraph matters only if it has a cue: of each template the commonest terms are set aside as long as they
alone cannot give ``LEAST`` (their part of the template's length bounds the cosine), and the others are its cues.

A directory's licence is that of the best file directly in it. A file without its own licence takes that of its nearest
ancestor directory that has one: the distinct directories of such files meet their ancestors by joins on paths, and
files then take what their directory found.

Templates are a parameter, as many as a task may hold (some thousands); the documents' counts are sums by term.

Defined results: null and empty texts have no licence of their own; a null path has no ancestors; equal scores go to the
longer template, then the one listed first, then to the least path; repeated rows give repeated rows; an empty table
gives none; columns other than those named are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, table, written

LEAST = 0.8
#: Directories that may be broadcast; above it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Public licence texts whose wording several share.
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
LIABLE = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
REDISTRIBUTE = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def gnu_notice(name: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."


#: Licence ids with the texts, headers, notices and titles that name them.
TEMPLATES = (
    ("MIT", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS} AND NONINFRINGEMENT. {LIABLE}"),
    ("BSD-2-Clause", f"{REDISTRIBUTE}\n{DISCLAIMER}"),
    ("BSD-3-Clause", f"{REDISTRIBUTE}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{DISCLAIMER}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", gnu_notice("General Public License", "3")),
    ("GPL-2.0", gnu_notice("General Public License", "2")),
    ("LGPL-3.0", gnu_notice("Lesser General Public License", "3")),
    ("LGPL-2.1", gnu_notice("Lesser General Public License", "2.1")),
    ("AGPL-3.0", gnu_notice("Affero General Public License", "3")),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSD-2-Clause", "Licensed under the 2-Clause BSD License."),
    ("ISC", "Licensed under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
SPDX = re.compile(r"SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.+-]+)", re.IGNORECASE)
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Matcher:
    """Templates as unit vectors over weighted terms."""

    def __init__(self, templates, df: dict[str, int], n_docs: int):
        self.weight = {t: math.log(1 + n_docs / (1 + df.get(t, 0))) for _, text in templates for t in terms(text)}
        self.other = math.log(1 + n_docs)
        self.vectors, self.size, self.by_term, self.cues = [], [], {}, set()
        self.ids = {name.lower(): name for name, _ in templates}
        self.places: dict[str, set[tuple[int, int]]] = {}  # of a cue: the terms before it in a template, and the template's number of terms
        for k, (name, text) in enumerate(templates):
            v = {t: n * self.weight[t] for t, n in Counter(terms(text)).items()}
            length = math.sqrt(sum(x * x for x in v.values())) or 1.0
            self.vectors.append(name)
            self.size.append(len(terms(text)))
            aside = 0.0
            for t, x in sorted(v.items(), key=lambda x: (self.weight[x[0]], x[0])):
                self.by_term.setdefault(t, []).append((k, x / length))
                aside += (x / length) ** 2
                if aside >= (LEAST - 1e-9) ** 2:
                    self.cues.add(t)
                    own = terms(text)
                    self.places.setdefault(t, set()).update((q, len(own)) for q, u in enumerate(own) if u == t)

    def cosine(self, unit) -> tuple[float, int]:
        """The best (cosine, template)."""
        found: dict[int, float] = {}
        square = 0.0
        for t, n in Counter(unit).items():
            x = n * self.weight.get(t, self.other)
            square += x * x
            for k, w in self.by_term.get(t, ()):
                found[k] = found.get(k, 0.0) + x * w
        if not found or square == 0:
            return 0.0, -1
        k = min(found, key=lambda k: (-round(found[k], 12), -self.size[k], k))
        return found[k] / math.sqrt(square), k

    def best(self, text: str | None) -> tuple[str | None, float]:
        if not text:
            return None, 0.0
        for m in SPDX.finditer(text) if "spdx" in text.lower() else ():
            name = re.sub(r"(-only|-or-later|\+)$", "", m[1].lower().rstrip("."))
            if name in self.ids:
                return self.ids[name], 1.0
        whole = terms(text)
        if self.cues.isdisjoint(whole):
            return None, 0.0
        units = {tuple(whole)}
        units |= {tuple(whole[a:b]) for a, b in {(max(0, i - q), i - q + n) for i, t in enumerate(whole) for q, n in self.places.get(t, ())}}
        for parts in (text.split("\n"), re.split(r"\n\s*\n", text)):
            units |= {tuple(u) for u in map(terms, parts) if not self.cues.isdisjoint(u)}
        score, _, k = max(((round(s, 12), self.size[k] if k >= 0 else 0, -k) for s, k in map(self.cosine, units)), default=(0.0, 0, 0))
        return (self.vectors[-k], score) if score >= LEAST else (None, 0.0)


def frequencies(docs: DataFrame, wanted: frozenset[str], text_col: str = "text") -> tuple[dict[str, int], int]:
    """Of how many documents has each wanted term, and how many there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for b in slices(batches):
            for t in b["text"]:
                found.update(wanted.intersection(terms(t or "")))
            found[""] += len(b)
        if found:
            yield pd.DataFrame({"term": list(found), "n": list(found.values())})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most one for each wanted term
    df = {r["term"]: r["n"] for r in rows}
    return df, df.pop("", 0)


def own(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """(row, id, path, own_license, own_score) for each row."""
    small_batches(docs.sparkSession)
    df, n = frequencies(docs, frozenset(t for _, text in templates for t in terms(text)), text_col)
    matcher = Matcher(templates, df, n)

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            best = [matcher.best(t) for t in texts]
            yield pd.DataFrame({"license": pd.Series([x for x, _ in best], dtype=object), "score": pd.Series([s for _, s in best], dtype=float)})

    found = F.pandas_udf(scan, "license string, score double")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias(id_col), F.col(path_col).alias("path"), found(text_col).alias("own"))
    return rows.select("row", id_col, "path", F.col("own.license").alias("own_license"), F.col("own.score").alias("own_score"))


def inherit(files: DataFrame) -> DataFrame:
    """``files`` (row, path, own_license, own_score, ...) with license and inherited_from (a directory, '' for the top; null for its own)."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    licensed = files.where("own_license is not null and path is not null").groupBy(folder.alias("above")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("best"))
    licensed = written(licensed.select("above", F.col("best.own_license").alias("folder_license")), "licensed")
    parts = F.split("folder", "/")
    lines = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    lacking = files.where("own_license is null and path is not null").select(folder.alias("folder")).distinct()  # each directory once, however many its files
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    nearest = lacking.select("folder", F.posexplode(lines).alias("depth", "above")).join(small(licensed), "above").groupBy("folder").agg(F.max(F.struct("depth", "above", "folder_license")).alias("from"))
    nearest = written(nearest, "nearest")
    own = F.col("own_license").isNull()
    found = files.withColumn("__folder", F.when(own, folder)).join(small(nearest.withColumnRenamed("folder", "__folder")), "__folder", "left")
    return found.select(*[c for c in files.columns if c != "row"], F.coalesce("own_license", "from.folder_license").alias("license"), F.col("from.above").alias("inherited_from"))


def layout(doc_id: str = "doc_id"):
    """A path for documents that have none: directories of ten, a hundred and a thousand ids; each one's first document lies one level up."""
    i = F.col(doc_id)
    folder = lambda n: F.concat(F.lit("d"), F.floor(i / n).cast("string"))
    name = F.concat(i.cast("string"), F.lit(".txt"))
    deep = F.concat_ws("/", folder(1000), folder(100), folder(10), name)
    return F.when(i % 100 == 0, F.concat_ws("/", folder(1000), name)).when(i % 10 == 0, F.concat_ws("/", folder(1000), folder(100), name)).otherwise(deep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", F.when(F.col("doc_id").isNotNull(), layout()))
    return inherit(written(own(docs), "files"))
