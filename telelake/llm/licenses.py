"""Licence scans with DataFrame functions only.

Method: canonical digest lookup. A text is put into canonical form: lower case, without
copyright lines, equivalent spellings made one, everything but letters and digits one
space. The digest of the entire canonical text is hash-joined to the digests of known
licences. The same lookup is made for each line, so a notice that is a line of a longer
document is found as the text that it is.

The known texts come from the caller or from this module; their number is bounded by
``KNOWN_LIMIT``, which is what allows their digests to be broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telelake.llm.rows import fresh

KNOWN_LIMIT = 10_000

# Wordings of licences and notices by their public identifiers.
KNOWN = [
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        ' associated documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or"
        ' substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS'
        " OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
        " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"
        " LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE"
        " SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE"
        ' SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL'
        " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
        " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR"
        " PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION"
        " WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
        " liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this"
        " software for any purpose, including commercial applications, and to alter it and redistribute it freely,"
        " subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must"
        " not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the"
        " product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly"
        " marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be"
        " removed or altered from any source distribution.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this"
        " list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above"
        " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
        " materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
        ' "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF'
        " MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR"
        " CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
        " (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR"
        " BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR"
        " TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF"
        " THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this"
        " list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above"
        " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
        " materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the"
        " names of its contributors may be used to endorse or promote products derived from this software without specific"
        " prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
        ' "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF'
        " MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR"
        " CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
        " (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR"
        " BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR"
        " TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF"
        " THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish,"
        " use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any"
        " purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the"
        " author or authors of this software dedicate any and all copyright interest in the software to the public domain."
        " We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors."
        " We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to"
        ' this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR'
        " IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
        " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN"
        " ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
        " DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

# Digests of the canonical forms of long licence texts, as published; with and
# without what follows the end of their terms.
LONG_TEXTS = {
    "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b": "Apache-2.0",
    "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause",
    "de4b88a2c819a4661af54f735069ed878216da8b4992b919b84afa18cfc0e54c": "CC0-1.0",
    "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71": "GFDL-1.2-only",
    "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6": "GFDL-1.3-only",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0-only",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0-only",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0-only",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0-only",
    "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68": "GPL-3.0-only",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0-only",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0-only",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0-only",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1-only",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1-only",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0-only",
    "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
}

# Equivalent spellings.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "authorisation": "authorization", "authorised": "authorized",
    "catalogue": "catalog", "centre": "center", "colour": "color", "favour": "favor", "fulfil": "fulfill",
    "honour": "honor", "judgement": "judgment", "labour": "labor", "licence": "license", "licences": "licenses",
    "licenced": "licensed", "modelled": "modeled", "offence": "offense", "organisation": "organization",
    "owner": "holder", "owners": "holders", "practise": "practice", "programme": "program", "recognised": "recognized",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# A text with none of these is no known licence; each known text has one.
ANCHOR = r"(?i)licen[cs]|permission|redistribut|warrant|public domain"
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[ \t]*(?:copyright|\(c\)|©|by\b|[0-9]{4}|[<\[{])[^\n]*$"
RESERVED = r"all rights reserved"
NO_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Canonical form of an entire text."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " "), RESERVED, " ")
    words = F.split(F.trim(F.regexp_replace(kept, NO_WORD, " ")), " ")
    same = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(same, w), w)), " ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(docs: DataFrame, known: Sequence[tuple[str, str]], digests: Mapping[str, str]) -> DataFrame:
    """Rows (digest, license); of several names for one wording the first in order."""
    if len(known) + len(digests) > KNOWN_LIMIT:
        raise ValueError(f"more than {KNOWN_LIMIT} known texts")
    mute = sorted(name for name, text in known if not re.search(ANCHOR, text))
    if mute:
        raise ValueError(f"known texts that would never be looked up, as they have no word of {ANCHOR}: {mute}")
    spark = docs.sparkSession
    texts = spark.createDataFrame(list(known), "license string, text string")
    ready = spark.createDataFrame(list(digests.items()), "digest string, license string")
    every = texts.select(digest(F.col("text")).alias("digest"), "license").unionByName(ready)
    return every.groupBy("digest").agg(F.min("license").alias("license"))


def scan(
    docs: DataFrame,
    known: Sequence[tuple[str, str]] = tuple(KNOWN),
    text: str = "text",
    out: str = "license",
    digests: Mapping[str, str] = MappingProxyType(LONG_TEXTS),
) -> DataFrame:
    """Add ``out``: struct of ``license`` and ``notices``.

    ``license`` names the licence that the entire text is, else null; ``notices`` are the
    distinct names, sorted, of the licences that single lines are in full. Null and empty
    texts have neither. Texts are never cut. Known licences are given as texts (``known``) or by
    the digests of their canonical forms. Repeated rows give equal results, an empty
    table stays empty.
    """
    mark = fresh("license")
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = docs.withColumn(f"{mark}_whole", F.when(body.rlike(ANCHOR), digest(body)))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(ANCHOR))
    # Lines are only cut apart where the text has an anchor at all.
    marked = marked.withColumn(
        f"{mark}_lines",
        F.when(F.col(f"{mark}_whole").isNotNull(), F.transform(lines, digest)).otherwise(F.array().cast("array<string>")),
    )
    # At most KNOWN_LIMIT rows.
    names = known_digests(docs, known, digests)
    whole = names.select(F.col("digest").alias(f"{mark}_whole"), F.col("license").alias(f"{mark}_license"))
    table = names.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("m"))
    joined = marked.join(F.broadcast(whole), f"{mark}_whole", "left")
    entries = table.first().m or {}
    lookup = F.create_map(*[F.lit(x) for pair in sorted(entries.items()) for x in pair]) if entries else None
    found = F.transform(f"{mark}_lines", lambda d: F.element_at(lookup, d)) if lookup is not None else F.array().cast("array<string>")
    notices = F.array_sort(F.array_distinct(F.array_compact(found)))
    return joined.select(
        *[F.col(f"`{c}`") for c in kept],
        F.struct(F.col(f"{mark}_license").alias("license"), notices.alias("notices")).alias(out),
    )


def sql(
    known: Sequence[tuple[str, str]] = tuple(KNOWN), digests: Mapping[str, str] = MappingProxyType(LONG_TEXTS)
) -> str:
    """The same result as SQL: doc_id, license, notices joined by commas, n_notices."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known)
    ready = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in digests.items())
    same = ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in SPELLINGS.items())

    def form(x: str) -> str:
        kept = f"regexp_replace(regexp_replace(lower({x}), {quoted(COPYRIGHT_LINE)}, ' ', 'g'), {quoted(RESERVED)}, ' ', 'g')"
        words = f"string_split(trim(regexp_replace({kept}, {quoted(NO_WORD)}, ' ', 'g')), ' ')"
        return f"sha256(array_to_string(list_transform({words}, lambda w: coalesce(same[w], w)), ' '))"

    return f"""
WITH spell AS (SELECT MAP {{{same}}} AS same),
known AS (SELECT digest, min(license) AS license FROM (
  SELECT license, {form('text')} AS digest FROM (VALUES {values}) AS v(license, text), spell
  UNION ALL SELECT license, digest FROM (VALUES {ready}) AS r(digest, license)) GROUP BY digest),
docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
hit AS (SELECT * FROM docs WHERE regexp_matches(text, {quoted(ANCHOR)})),
whole AS (SELECT row, {form('text')} AS digest FROM hit, spell),
lines AS (SELECT row, {form('line')} AS digest FROM
  (SELECT row, unnest(string_split(text, chr(10))) AS line FROM hit), spell WHERE regexp_matches(line, {quoted(ANCHOR)})),
noted AS (SELECT row, string_agg(DISTINCT license, ',' ORDER BY license) AS notices,
  count(DISTINCT license) AS n_notices FROM lines JOIN known USING (digest) GROUP BY row)
SELECT doc_id, known.license AS license, coalesce(notices, '') AS notices, coalesce(n_notices, 0)::BIGINT AS n_notices
FROM docs LEFT JOIN whole USING (row) LEFT JOIN known USING (digest) LEFT JOIN noted USING (row)
"""
