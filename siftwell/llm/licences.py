"""Known licences by the digest of their canonical text.

A text is made canonical by ``LINES`` and ``STEPS``: copyright lines gone, lower
case, punctuation and white space as single blanks, equivalent spellings as one. Its
SHA-256 is then joined with the digests of the known licences, made by the same
steps, so two texts match exactly if they say the same. Entire texts are
compared; besides, every line that could be a short notice (``HINT``, which all
notices hold) is compared as a text of its own.

Texts are read once and only their digests are written and joined, so no text
is shuffled or seen by Python. Spark broadcasts the catalogue while it is small
and splits a hot digest where it is not, as all joins are between written tables.

Defined results: a null text is empty; an empty canonical text is no licence.
Rows with the same id and text share their findings, each row keeping its own
line; null ids are ids; an empty table gives an empty result. Texts of any
length are hashed whole, their lines too. ``scan`` returns
the id and its findings only, so no column can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.session import written

from .common import text_key

#: Lines to be cut: a sign, a year, a place for one or a capitalised holder's name has to follow, as a wrapped "copyright
#: holders be liable" or "copyright doctrines" is text.
LINES = (
    r"(?md)^[ \t\r#*/;-]*(?:©|(?i:\(c\))[ \t]*(?:[0-9<\[{]|©)|(?i:copyright)[ \t:]+(?:(?i:by)[ \t]|©|(?i:\(c\))|[0-9<\[{]"
    r"|(?!Holder|Owner|Notice|Licen[cs]e|Law|Statement)\p{Lu}\p{Ll}))[^\n]*",
    r"(?mdi)^[ \t\r#*/;-]*all rights reserved\.?[ \t\r]*$",
)
#: Pattern and replacement, in order, after lower-casing A-Z and the like.
STEPS = (
    (r"[^\p{L}\p{N}]+", " "),
    (r"\blicence", "license"),
    (r"\bsub (licens)", r"sublicens"),
    (r"\bnon (infring|commercial|exclusive)", r"non$1"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bcopyright (?:holders?|owners?)\b", "copyright holder"),
    (r"\bwhilst\b", "while"),
    (r"\b(v|ver) ?(\d)", r"version $2"),
    (r"\bhttps? (www )?", "url "),
    (r"^ +| +$", ""),
)
HINT = "(?i)licen[cs]e"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
{0}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD2 = _BSD.format("")
_BSD3 = _BSD.format("""
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
""")

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.

3. This notice may not be removed or altered from any source distribution."""

# Licence texts and notices as their publishers word them.
CATALOGUE = (
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("ISC", "The ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD2), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD2),
    ("BSD-2-Clause", "The 2-Clause BSD License\n\n" + _BSD2),
    ("BSD-3-Clause", _BSD3), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD3),
    ("BSD-3-Clause", "The 3-Clause BSD License\n\n" + _BSD3),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

# Digests of the canonical whole texts of long licences, as published, with their appendices.
DIGESTS = (
    ("Apache-2.0", "244f16240a0413ab6a00edfa7a82f8c097a9e7d581a75f793e05c100e63edb70"),
    ("MPL-2.0", "966842c24517a7a17e34051a793caf88aaebef11abcc08cb7d101649a71d4a89"),
    ("MPL-1.1", "583f0f7affeab4b8b4d10bad19a81bb7ed6ba94a395ef8e8ea884c01815983a0"),
    ("GPL-2.0", "c683128a79af968653f7a06709159e41adcfcb00ca1e8ab9ffa1d516dcf82123"),
    ("GPL-3.0", "00f23ed40c17cb9d924a40e2ffd7a1dd2f4855de1d25c06155481a238b22b2d6"),
    ("LGPL-2.1", "bc7898eef7d53923eff574c7a898468049b8e1e90eef19ba0b8132904dd70a66"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("CC0-1.0", "ee4f004efcecdf9d9069648b3868636b6aed9a7d8fa7a8319d5d5b4ac94ae44d"),
)


def canonical(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for pattern in LINES:
        text = F.regexp_replace(text, pattern, "")
    text = F.lower(text)
    for pattern, new in STEPS:
        text = F.regexp_replace(text, pattern, new)
    return text


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def catalogue(spark) -> DataFrame:
    """(digest, licence): one row for each canonical text."""
    known = spark.createDataFrame(list(CATALOGUE), "licence string, text string")
    long = spark.createDataFrame(list(DIGESTS), "licence string, digest string")
    return known.select(digest(F.col("text")).alias("digest"), "licence").union(long.select("digest", "licence")).distinct()


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", known: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_sha256, licence, notices, n_notices), one row for each document.

    ``licence`` is that of the entire text, ``notices`` the sorted licences that
    single lines name, comma-joined, ``n_notices`` how many lines do. ``known``
    is a catalogue of (digest, licence) of any size; a digest with several names
    goes by the first of them.
    """
    known = catalogue(docs.sparkSession) if known is None else known
    known = written(known.groupBy(F.col("digest").alias("known")).agg(F.min("licence").alias("licence")))
    body = F.coalesce(docs[f"`{text}`"], F.lit(""))
    lines = F.transform(F.filter(F.split(body, "\n"), lambda x: x.rlike(HINT)), digest)
    rows = written(docs.select(*text_key(docs, text, doc_id), digest(body).alias("text_sha256"),
                               F.when(body.rlike(HINT), lines).otherwise(F.array().cast("array<string>")).alias("lines")))
    each = rows.where(F.size("lines") > 0).dropDuplicates(["doc_id", "text_key"]).select(
        F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), F.explode("lines").alias("line"))
    said = written(each.join(known, F.col("line") == F.col("known")).groupBy("__d", "__k").agg(
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"), F.count("*").alias("n_notices")))
    return rows.join(known, F.col("text_sha256") == F.col("known"), "left").join(
        said, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_key") == F.col("__k")), "left").select(
        "doc_id", "text_sha256", "licence", F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
