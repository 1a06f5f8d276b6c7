"""License scans (9): canonical digest lookup of entire texts.

A text is made canonical: copyright and "all rights reserved" lines go, case
folds, equivalent spellings become one, and everything that is no letter or
digit becomes one blank.  Its digest is looked up by a hash join among the
digests of the known texts.  The units are the whole document and each of its
lines with a word, so that one-line notices in longer texts are found too; a
line that has no known digest is no license, however similar.

Defined results: null and empty texts match nothing; repeated rows each get
their result; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.catalog import register
from jobsift.llm.common import documents, on_key, text_key, whole_text

#: Lines that say who holds a right, not what a license grants.
OWNER_LINE = r"(?m)^[^A-Za-z0-9\n]*(?:[Cc]opyright\b|COPYRIGHT\b|\([Cc]\)|©|[Aa]ll [Rr]ights [Rr]eserved)[^\n]*$"

#: Spelling and its equivalent, as whole words of the canonical text.
EQUIVALENT = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"),
    ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labour", "labor"), ("merchantibility", "merchantability"), ("modelling", "modeling"), ("noncommercial", "non commercial"),
    ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("http", "https"), ("v", "version"),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""

#: Fixed values: (license, text).  Whole license texts, standard file headers and one-line notices.
KNOWN_TEXTS = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_NAMES + _BSD_END),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]


def canonical(text: Column) -> Column:
    """Letters and digits in lower case, blanks between, owner lines gone, spellings made one."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, OWNER_LINE, " ")), r"[^\p{L}\p{N}]+", " ")
    spelled = reduce(lambda t, pair: F.replace(t, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), EQUIVALENT, F.concat(F.lit(" "), F.trim(plain), F.lit(" ")))
    return F.trim(spelled)


def digest(text: Column) -> Column:
    """Digest of the canonical text; null if nothing of it is left."""
    made = canonical(text)
    return F.when(made != "", F.sha2(made, 256))


def canonical_words(text: str) -> list[str]:
    """The words of a known text before spellings are made one."""
    return re.findall(r"[^\W_]+", re.sub(OWNER_LINE, " ", text).lower())


def opening_words(texts: list[tuple[str, str]]) -> list[str]:
    """First words that a text with a known digest can have, in any spelling."""
    first = {w[0] for _, t in texts if (w := canonical_words(t))}
    spelled = {b.split()[0] for a, b in EQUIVALENT if a.split()[0] in first} | first
    return sorted(spelled | {a.split()[0] for a, b in EQUIVALENT if b.split()[0] in spelled})


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """license, digest: one row per known digest.  The number of known texts bounds it."""
    rows = spark.createDataFrame(KNOWN_TEXTS if texts is None else texts, "license string, text string")
    return rows.select(digest(F.col("text")).alias("_op_digest"), "license").where("_op_digest is not null").groupBy("_op_digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document with doc_id, digest, license (of the whole text), notices (licenses of single lines) and n_notices."""
    text, known = whole_text(), F.broadcast(known_digests(docs.sparkSession, texts))
    rows = docs.select(*text_key(F.col("doc_id"), text), text.alias("_op_text"))
    lines = rows.select("_op_id", "_op_h1", "_op_h2", F.posexplode(F.split("_op_text", "\n")).alias("_op_pos", "_op_line"))
    # a line that opens with another word has no known digest
    lines = lines.where(F.lower(F.regexp_extract("_op_line", r"[\p{L}\p{N}]+", 0)).isin(opening_words(KNOWN_TEXTS if texts is None else texts)))
    found = (lines.withColumn("_op_digest", digest(F.col("_op_line"))).join(known, "_op_digest")
             .select("_op_id", "_op_h1", "_op_h2", "_op_pos", "license").distinct()
             .groupBy("_op_id", "_op_h1", "_op_h2").agg(F.array_sort(F.collect_set("license")).alias("notices"), F.count("*").alias("n")))
    whole = rows.withColumn("_op_digest", digest(F.col("_op_text"))).join(known, "_op_digest", "left").drop("_op_text")
    return whole.alias("d").join(found.alias("f"), on_key("d", "f"), "left").select(
        F.col("d._op_id").alias("doc_id"), F.col("d._op_digest").alias("digest"), F.col("d.license").alias("license"),
        F.coalesce(F.col("f.notices"), F.array().cast("array<string>")).alias("notices"), F.coalesce(F.col("f.n"), F.lit(0)).cast("long").alias("n_notices"))


def oracle() -> str:
    """DuckDB SQL of the query."""

    def made(text: str) -> str:
        out = (rf"(' ' || trim(regexp_replace(lower(regexp_replace({text}, '{OWNER_LINE}', ' ', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ')")
        for a, b in EQUIVALENT:
            out = f"replace({out}, ' {a} ', ' {b} ')"
        return f"trim({out})"

    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN_TEXTS)
    return f"""
WITH units AS (SELECT doc_id, 0 AS pos, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1), unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
made AS (SELECT doc_id, pos, {made('t')} AS c FROM units),
known AS (SELECT sha256({made('t')}) AS digest, min(n) AS license FROM (VALUES {quoted}) AS v(n, t) GROUP BY 1),
hit AS (SELECT doc_id, pos, CASE WHEN c <> '' THEN sha256(c) END AS digest FROM made),
found AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices, count(*) AS n FROM hit JOIN known USING (digest) WHERE pos > 0 GROUP BY doc_id)
SELECT h.doc_id, h.digest, k.license, coalesce(f.notices, '') AS notices, coalesce(f.n, 0) AS n_notices
FROM hit h LEFT JOIN known k USING (digest) LEFT JOIN found f ON f.doc_id = h.doc_id WHERE h.pos = 0"""


@register("op9_license_digests", oracle())
def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).withColumn("notices", F.array_join("notices", ","))
