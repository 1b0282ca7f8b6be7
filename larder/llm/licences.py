"""License scan: canonical digests of whole texts, joined to those of known licences.

A text is made canonical, then digested: lower case; lines that state a copyright (by a sign,
a year or "by", or as the first line, a blank one after it) and the words "all rights reserved" go; every run of punctuation and white space becomes one space; equivalent
spellings become one. Two texts that differ in these alone have one digest.

``KNOWN`` is the default table of licences: short texts with and without their title lines and
list numbers, the whole texts in the folder ``licence_texts``, and common notices; ``scan`` takes any DataFrame of (license, text).

Defined cases: a missing text has no digest and no licence. An empty one has the digest of
nothing and matches nothing. Where known texts share a digest the smaller name is given.
Repeated documents are reported row by row; other columns are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_YEAR = r"([12][0-9]{3}|[<\[{(]?(year|yyyy))"
COPYRIGHT_LINE = (
    r"(^|\n)[ \t*#/;-]*(copyright[ \t:]*(\(c\)|\x{A9}|by[ \t]|" + _YEAR + r")|\(c\)[ \t,]*(copyright|"
    + _YEAR + r")|\x{A9})[^\n]*|^[ \t*#/;-]*copyright[ \t][^\n]*\n[ \t]*(\n|$)"
)
RIGHTS = r"all rights reserved"
NOT_WORDS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

# Spellings that are the same in a licence, rarer form first.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"),
    ("sublicence", "sublicense"), ("merchantibility", "merchantability"),
    ("organisation", "organization"), ("organisations", "organizations"),
    ("authorised", "authorized"), ("authorisation", "authorization"),
    ("favour", "favor"), ("honour", "honor"), ("labour", "labor"),
    ("recognised", "recognized"), ("noncommercial", "non commercial"),
    ("acknowledgement", "acknowledgment"), ("fulfilment", "fulfillment"),
    ("judgement", "judgment"), ("programme", "program"), ("whilst", "while"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("http", "https"),
)

# Published licence texts and common notices.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
    "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
    "OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
    "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BARE = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     'software and associated documentation files (the "Software"), to deal in the Software '
     "without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
     "to whom the Software is furnished to do so, subject to the following conditions:\n\nThe "
     "above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software.\n\n" + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
     "or without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies.\n\n" + _ISC_AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose "
     "with or without fee is hereby granted.\n\n" + _ISC_AS_IS),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + "3. Neither the name of the copyright holder nor the names of "
     "its contributors may be used to endorse or promote products derived from this software "
     "without specific prior written permission.\n" + _BSD_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no "
     "event will the authors be held liable for any damages arising from the use of this "
     "software.\n\nPermission is granted to anyone to use this software for any purpose, including "
     "commercial applications, and to alter it and redistribute it freely, subject to the "
     "following restrictions:\n\n1. The origin of this software must not be misrepresented; you "
     "must not claim that you wrote the original software. If you use this software in a product, "
     "an acknowledgment in the product documentation would be appreciated but is not required.\n2. "
     "Altered source versions must be plainly marked as such, and must not be misrepresented as "
     "being the original software.\n3. This notice may not be removed or altered from any source "
     "distribution."),
    ("Apache-2.0 notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may '
     "not use this file except in compliance with the License. You may obtain a copy of the License "
     "at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or "
     "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
     "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
     "License for the specific language governing permissions and limitations under the License."),
    ("MIT line", "Released under the MIT License."),
    ("Apache-2.0 line", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0 line", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0 line", "Licensed under CC BY-NC 4.0."),
)
_TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License",
                     "Simplified BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License",
                     "New BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
}


def _dressed() -> Iterator[tuple[str, str]]:
    """Short licences with each title, and with and without the numbers of their lists."""
    for name, text in _BARE:
        for body in dict.fromkeys((re.sub(r"(?m)^[0-9]\. ", "", text), text)):
            yield from ((name, f"{title}\n\n{body}") for title in _TITLES.get(name, ()))
            yield name, body


def _published() -> Iterator[tuple[str, str]]:
    folder = resources.files(__package__).joinpath("licence_texts")
    for file in sorted(folder.iterdir(), key=lambda f: f.name):
        yield file.name.removesuffix(".txt"), file.read_text("utf-8")


KNOWN = (*_published(), *_dressed())


def canonical(text: Column) -> Column:
    """Words of the text that matter, each with one space before and after."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1")
    out = F.regexp_replace(out, NOT_WORDS, " ")
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    out = F.replace(out, F.lit(f" {RIGHTS} "), F.lit(" "))
    out = F.replace(out, F.lit(" "), F.lit("  "))  # neighbours share no space
    for rare, usual in SPELLINGS:
        rare, usual = (x.replace(" ", "  ") for x in (rare, usual))
        out = F.replace(out, F.lit(f" {rare} "), F.lit(f" {usual} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "license string, text string")


def scan(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, the digest of its whole canonical text, and the licence of that digest if known."""
    known = known if known is not None else known_texts(documents.sparkSession)
    named = known.where(F.length(canonical(F.col("text"))) > 0).groupBy(
        digest(F.col("text")).alias("_digest")
    ).agg(F.min("license").alias("license"))
    return documents.select("doc_id", digest(F.col("text")).alias("digest")).join(
        named, F.col("digest") == F.col("_digest"), "left"
    ).select("doc_id", "digest", "license")


def twin() -> str:
    """The scan of ``documents`` in DuckDB SQL."""
    def of(text: str) -> str:
        out = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '\\1', 'g')"
        out = f"regexp_replace({out}, '{NOT_WORDS}', ' ', 'g')"
        out = f"replace(' ' || trim({out}) || ' ', ' {RIGHTS} ', ' ')"
        out = f"replace({out}, ' ', '  ')"
        for rare, usual in SPELLINGS:
            rare, usual = (x.replace(" ", "  ") for x in (rare, usual))
            out = f"replace({out}, ' {rare} ', ' {usual} ')"
        return f"trim(replace({out}, '  ', ' '))"

    rows = ", ".join(
        "({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in row)) for row in KNOWN
    )
    return f"""
        WITH known(license, text) AS (VALUES {rows}),
        named AS (SELECT sha256({of('text')}) AS digest, min(license) AS license
                  FROM known GROUP BY 1),
        seen AS (SELECT doc_id, sha256({of('text')}) AS digest FROM documents)
        SELECT doc_id, seen.digest AS digest, license FROM seen LEFT JOIN named USING (digest)"""
