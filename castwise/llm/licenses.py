"""Licence scan by canonical digests.

A text is normalised (case, copyright lines, punctuation and white space,
equivalent spellings), digested whole with SHA-256, and the digest is joined
with those of the known licences. Scanned texts are the whole documents and
each of their lines (a notice usually stands on a line of its own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A copyright line, lower-cased (fixed pattern; Java and RE2 read it alike).
COPYRIGHT_LINE = r"^[^a-z0-9]*(copyright[^a-z0-9]*(\(c\)|©|[0-9]{4}|<|\[|\{|the [a-z ]{0,60}authors|[a-z0-9 ,&-]{1,60}[^a-z0-9](inc|llc|ltd|gmbh)\b)|\(c\)[^a-z0-9]*[0-9]{4}|©|all rights reserved)[^\n]*$"
NOT_A_WORD = r"[^\p{L}\p{N}]+"

#: Equivalent spellings, written as the second form (fixed values).
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analyse": "analyze", "artefact": "artifact", "authoris": "authoriz",
    "behaviour": "behavior", "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "customis": "customiz",
    "favour": "favor", "fulfilment": "fulfillment", "judgement": "judgment", "labour": "labor", "licence": "license",
    "modelled": "modeled", "non commercial": "noncommercial", "offence": "offense", "organis": "organiz",
    "per cent": "percent", "programme ": "program ", "recognis": "recogniz", "sub license": "sublicense",
    "utilis": "utiliz", "whilst": "while", "wilful": "willful",
}

#: Notices and short licences by SPDX identifier (fixed values).
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", """MIT License

Copyright (c) 2000 the authors

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) 2000 the authors

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """Copyright (c) 2000 the authors

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
)


#: The BSD licences, put together from their parts.
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN += tuple((name, title + _BSD_CONDITIONS + names + disclaimer)
               for name, names, heading in (("BSD-2-Clause", "", "BSD 2-Clause License\n"), ("BSD-3-Clause", _BSD_NAMES, "BSD 3-Clause License\n"))
               for title in ("", heading)
               for disclaimer in (_BSD_DISCLAIMER, _BSD_DISCLAIMER.replace("HOLDER OR", "OWNER OR")))

#: Further notices of the licences (fixed values).
KNOWN += tuple((name, notice) for name, notices in (
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0")),
    ("MIT", ("Licensed under the MIT License.", "SPDX-License-Identifier: MIT")),
    ("BSD-2-Clause", ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause")),
    ("BSD-3-Clause", ("Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause")),
    ("ISC", ("Licensed under the ISC License.", "SPDX-License-Identifier: ISC")),
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0")),
    ("GPL-2.0-only", ("SPDX-License-Identifier: GPL-2.0-only",)),
    ("GPL-3.0-only", ("SPDX-License-Identifier: GPL-3.0-only",)),
    ("AGPL-3.0-only", ("SPDX-License-Identifier: AGPL-3.0-only",)),
    ("LGPL-3.0-only", ("SPDX-License-Identifier: LGPL-3.0-only",)),
    ("CC-BY-4.0", ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.")),
    ("CC-BY-SA-4.0", ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.")),
    ("Unlicense", ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense")),
) for notice in notices)


#: (license, SHA-256, length, first 20 characters) of the canonical forms of whole texts too long to stand here, with and without their appendix.
DIGESTS = (
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2", 9882, "apache license versi"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0", 8866, "apache license versi"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702", 5833, "the artistic license"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692, "creative commons leg"),
    ("GFDL-1.2-only", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f", 19579, "gnu free documentati"),
    ("GFDL-1.3-only", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7", 22015, "gnu free documentati"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", 11765, "gnu general public l"),
    ("GPL-1.0-only", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", 9415, "gnu general public l"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", 17117, "gnu general public l"),
    ("GPL-2.0-only", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", 14483, "gnu general public l"),
    ("GPL-3.0-only", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68", 33409, "gnu general public l"),
    ("GPL-3.0-only", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", 30968, "gnu general public l"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", 24130, "gnu library general "),
    ("LGPL-2.0-only", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260", 22277, "gnu library general "),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", 25217, "gnu lesser general p"),
    ("LGPL-2.1-only", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", 23365, "gnu lesser general p"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104, "gnu lesser general p"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986", 22448, "mozilla public licen"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a", 14341, "mozilla public licen"),
)


def plain_lines(text: Column) -> Column:
    """The lines of a text as lower-case words with one blank between them; copyright lines are empty."""
    return F.transform(F.split(F.lower(text), "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, F.lit(COPYRIGHT_LINE), F.lit("")), F.lit(NOT_A_WORD), F.lit(" "))))


def joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def one_spelling(text: Column) -> Column:
    for old, new in SPELLINGS.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normalise(text: Column) -> Column:
    """The canonical form of a text."""
    return one_spelling(joined(plain_lines(text)))


#: How much the spellings can shorten or lengthen a text.
SHRINK = min(len(new) / len(old) for old, new in SPELLINGS.items())
GROW = max(len(new) / len(old) for old, new in SPELLINGS.items())


HEAD = 20  # characters by which a text is taken for a possible licence


def known_licenses(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(license, text) of the licences known by default."""
    return spark.createDataFrame(list(known), "license string, text string")


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", more: tuple[tuple[str, str, int, str], ...] = DIGESTS) -> DataFrame:
    """(doc_id, license, n_whole, n_lines): the licences found, one row per id and licence.

    n_whole counts rows whose entire text is the licence, n_lines lines that
    are. Rows that repeat an id are counted together; null ids form one group.
    Null texts and texts without words match nothing, nor does a known text
    without words; documents without a licence have no row. ``known`` may list
    several texts for one licence and repeat them; ``more`` adds licences of
    which only the digest is held. Other columns are not read.
    """
    texts = (known.select("license", normalise(F.col("text")).alias("canonical")).where("license is not null and canonical <> ''").distinct())
    texts = texts.select("license", F.sha2(F.col("canonical").cast("binary"), 256).alias("digest"), F.length("canonical").alias("n"), F.substring("canonical", 1, HEAD).alias("head"))
    if more:
        texts = texts.union(docs.sparkSession.createDataFrame(list(more), "license string, digest string, n int, head string")).distinct()
    digests = texts.select("license", "digest").distinct()
    size = texts.agg(F.collect_set("head").alias("heads"), F.coalesce(F.min("n"), F.lit(1)).alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()

    def digest(x: Column) -> Column:  # only of texts that can have the length of a known one and begin like one
        fits = F.length(x).between(int(size.least / GROW), int(size.most / SHRINK) + 1)
        fits &= F.substring(one_spelling(F.substring(x, 1, 4 * HEAD)), 1, HEAD).isin(size.heads)
        return F.when(fits, F.sha2(one_spelling(x).cast("binary"), 256))

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null").select("doc_id", plain_lines(F.col("text")).alias("lines"))
    entry = lambda whole, x: F.struct(F.lit(whole).alias("whole"), digest(x).alias("digest"))
    every = F.concat(F.array(entry(True, joined(F.col("lines")))), F.transform("lines", lambda x: entry(False, x)))
    # outer: a plain explode adds a filter on the array, for which the lines would be normalised again
    found = d.select("doc_id", F.explode_outer(F.filter(every, lambda x: x["digest"].isNotNull())).alias("x")).select("doc_id", "x.whole", "x.digest")
    return (found.join(digests, "digest").groupBy("doc_id", "license")
            .agg(F.count_if("whole").alias("n_whole"), F.count_if(~F.col("whole")).alias("n_lines")))


def oracle(known: tuple[tuple[str, str], ...] = KNOWN, more: tuple[tuple[str, str, int, str], ...] = DIGESTS) -> str:
    """DuckDB SQL of ``scan`` over ``documents``."""
    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def lines(x: str) -> str:
        one = f"trim(regexp_replace(regexp_replace(l, {quote(COPYRIGHT_LINE)}, ''), {quote(NOT_A_WORD)}, ' ', 'g'))"
        return f"list_transform(string_split(lower({x}), chr(10)), lambda l: {one})"

    def spelled(x: str) -> str:
        for old, new in SPELLINGS.items():
            x = f"replace({x}, {quote(old)}, {quote(new)})"
        return x

    def canonical(x: str) -> str:
        return spelled(f"array_to_string(list_filter({lines(x)}, lambda l: l <> ''), ' ')")

    rows = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known)
    held = ''.join(f" UNION SELECT {quote(a)}, {quote(b)}" for a, b, *_ in more)
    return f"""
WITH known AS (SELECT DISTINCT license, sha256({canonical('t')}) AS digest FROM (VALUES {rows}) AS k(license, t){held}),
found AS (SELECT doc_id, 1 AS whole, 0 AS line, sha256({canonical('text')}) AS digest FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, 0, 1, sha256({spelled('l')}) FROM (SELECT doc_id, unnest({lines('text')}) AS l FROM documents WHERE text IS NOT NULL))
SELECT doc_id, license, sum(whole)::BIGINT AS n_whole, sum(line)::BIGINT AS n_lines FROM found JOIN known USING (digest) GROUP BY doc_id, license
"""
