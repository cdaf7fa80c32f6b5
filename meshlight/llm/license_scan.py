"""Operator 6, licence scans: canonical digest lookup.

A text is made canonical (case, punctuation, copyright lines, equivalent
spellings, white space), hashed, and joined to the digests of known licence
texts and notices. The texts looked up are the entire document and each of
its lines. Nothing is searched inside a line: a line that says more than a
known notice is no match.

The known digests are a table of fixed size, so the join broadcasts it; no
text is shuffled, only matches are grouped by doc_id. Null, empty and blank
texts match nothing. Repeated rows of one doc_id give one row.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_text

#: Licence names as notices write them, by SPDX identifier.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache-2.0 license", "Apache 2.0 License"],
    "MIT": ["MIT License", "MIT"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL v3", "GPLv3", "GPL-3.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL v2", "GPLv2", "GPL-2.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause", "3-Clause BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause", "2-Clause BSD License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "MPL-2.0"],
    "ISC": ["ISC License", "ISC"],
    "CC0-1.0": ["CC0 1.0", "CC0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
}
#: How notices begin; a notice is one of these and a name.
OPENINGS = ["Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This file is licensed under", "This project is licensed under", "This software is licensed under", "SPDX-License-Identifier:"]
#: Entire licence texts.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}
#: Digests of the canonical form of further entire texts, with and without what follows their terms.
DIGESTS = {
    "Apache-2.0": ["1194adb25e7540f77d57931f8ad90e5612dd3ae3217c04bcd0df53d63111f7c4", "955fce7767758d2694d6b82c1f7c1c9b00cea363031fef20601cf7e6f7cb796a", "ac4caf86a3a9015c02bc6dd5dab8853468c3d4ad9965ba458b5ea64ffd7561d3"],
    "BSD-2-Clause": ["a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"],
    "CC-BY-SA-4.0": ["06d22f0e3a6b0cc51abb77214a63da8b02d43eef3b90a7d13bc428a64ef0e8a3"],
    "CC0-1.0": ["92f195ae84ff559b03177551e6c1166f57d3cc30f5a7d806b4039e24906bd8de"],
    "GPL-2.0": ["51666f162540b1cee141bdc13e100b8583214ae131ff388238b1af3523860a64", "667e636b2ed323c228e8426de94fc4852d066c4b274e3e6213bcbb7bf53a54ea", "76f0d880e6ba8aebe23e15979004b0c84e86e4dbb2307f1ca2d570e109df9707", "8421e8e974227f5e17d98aac8b42f87f0f3b0cd76e0b857557e02409eb362940", "96cf6b00d09b303d628c94daf75c4c6fa990ed64ae2684c7ed2b7b92a3b56ff2", "e68b1db4517453c7e7fc05d2e9c03a4e908ee80f975984697961e2dffa682df6"],
    "GPL-3.0": ["009ae8dfd1a9d69050f8e46eaf1de39ae9e3be1e4515dfaaa23d7a66b736b406", "0fb1f5ccc80f73cf8fdd3aeb4f198f392905f38516273cf881d75c10517204c4", "12ea386c51594e10ebdd02b564052966dbe008c49fefd2b258bb4e8cb485ea1b", "494973d552242836ba7a5813ee0dea8e621a5496585fd5d73761e8b79a844624", "52f05246a365b2e89675dfebb201e2da8f698f369b3087bc86135dfcbd89c8e0", "e04d849565216087bf43d5f41461b4e1678ac30edc6c47b3e503c619ef9f7e94"],
    "LGPL-3.0": ["4d2f65a1f943216cd035610b9db1feb9151d197efffff29e287f675a0b018611"],
    "MPL-2.0": ["1f73c9877753ecf4aa51d0e3130945619dccb798244b982a2722059ea77c1770"],
}
#: Spellings that count as the same, after case and punctuation are gone, in this order.
EQUAL = [("licence", "license"), ("licenced", "licensed"), ("noncommercial", "non commercial"), ("sublicence", "sublicense"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("version", "v"), ("https", "http")]

#: What owner lines begin with, and what such a line goes on with if a sentence of a licence does; the SQL asks for the two one by one, as RE2 has no lookahead.
NOTICE, MARK = r"[ \t]+(?:notices?|holders?|owners?|law|licen[sc]es?|statements?|and|or|in|to|interest|treaty|disclaimers?)\b", r"[ \t]+(?:you|an?|any|all|if|to|in|by|use|such|this)\b"
OWNER = r"^[ \t]*(?:copyright\b|\(c\)|©|all rights reserved)"
SENTENCE = rf"^[ \t]*(?:copyright{NOTICE}|\(c\){MARK})"
OWNER_LINE = rf"(?m)^[ \t]*(?:copyright\b(?!{NOTICE})|\(c\)(?!{MARK})|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"
OPEN_THE = r"\b(under|identifier) the "
NUMBERED = r"\bv ?([0-9]+)(?: 0)?\b"


def canonical(text: Column) -> Column:
    """The canonical form of a text, in built-in functions."""
    out = F.regexp_replace(F.lower(text), OWNER_LINE, " ")
    out = F.trim(F.regexp_replace(out, NOT_WORD, " "))
    for spelling, same in EQUAL:
        out = F.regexp_replace(out, rf"\b{spelling}\b", same)
    out = F.regexp_replace(out, OPEN_THE, "$1 ")
    return F.trim(F.regexp_replace(out, NUMBERED, "v$1"))


def canonical_py(text: str) -> str:
    """The same for the table of known texts."""
    out = re.sub(OWNER_LINE, " ", text.lower())
    out = re.sub(r"[\W_]+", " ", out).strip(" ")
    for spelling, same in EQUAL:
        out = re.sub(rf"\b{spelling}\b", same, out)
    out = re.sub(OPEN_THE, r"\1 ", out)
    return re.sub(NUMBERED, r"v\1", out).strip(" ")


@cache
def known() -> dict[str, str]:
    """Digest -> SPDX identifier, of all notices by rule and all entire texts."""
    texts = [(spdx, f"{opening} {name}") for spdx, names in NAMES.items() for opening, name in product(OPENINGS, names)]
    texts += [*TEXTS.items(), *((spdx, f"{spdx} License\n{t}") for spdx, t in TEXTS.items())]
    return {hashlib.sha256(canonical_py(t).encode()).hexdigest(): spdx for spdx, t in texts}


@cache
def known_whole() -> dict[str, str]:
    """Further entire texts, and headings as published files write them."""
    heads = [("MIT", f"The MIT License (MIT)\n{TEXTS['MIT']}"), ("MIT", f"The MIT License\n{TEXTS['MIT']}"), ("ISC", f"The ISC License\n{TEXTS['ISC']}"), ("BSD-3-Clause", f"BSD 3-Clause License\n{TEXTS['BSD-3-Clause']}"), ("BSD-3-Clause", f"The 3-Clause BSD License\n{TEXTS['BSD-3-Clause']}"), ("BSD-3-Clause", TEXTS["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "))]
    return {hashlib.sha256(canonical_py(t).encode()).hexdigest(): spdx for spdx, t in heads} | {d: spdx for spdx, own in DIGESTS.items() for d in own}


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document with a match: doc_id, licenses (SPDX identifiers, sorted, comma-joined), n_lines, whole_text."""
    spark = docs.sparkSession
    digests = spark.createDataFrame(sorted((known() | known_whole()).items()), "digest string, spdx string")
    text = doc_text()
    unit = lambda t, whole: F.struct(F.sha2(canonical(t), 256).alias("digest"), F.lit(whole).alias("whole"))
    units = F.array_union(F.array(unit(text, 1)), F.transform(F.array_distinct(F.split(text, "\n", -1)), lambda t: unit(t, 0)))
    found = docs.select("doc_id", F.inline(units)).join(F.broadcast(digests), "digest")
    return found.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("spdx")), ",").alias("licenses"),
        F.count_distinct(F.when(F.col("whole") == 0, F.col("digest"))).alias("n_lines"),  # one for lines that repeat, in rows that repeat too
        (F.max("whole") == 1).alias("whole_text"),
    )


def oracle() -> str:
    """The same as SQL; RE2 writes groups as \\1 and has no lookahead, so owner lines are judged one by one."""
    def canon(x: str) -> str:
        out = f"array_to_string(list_transform(string_split(lower({x}), chr(10)), lambda l: CASE WHEN regexp_matches(l, '{OWNER}') AND NOT regexp_matches(l, '{SENTENCE}') THEN ' ' ELSE l END), chr(10))"
        out = f"trim(regexp_replace({out}, '{NOT_WORD}', ' ', 'g'), ' ')"
        for spelling, same in EQUAL:
            out = f"regexp_replace({out}, '\\b{spelling}\\b', '{same}', 'g')"
        out = f"regexp_replace({out}, '{OPEN_THE}', '\\1 ', 'g')"
        return f"trim(regexp_replace({out}, '{NUMBERED}', 'v\\1', 'g'), ' ')"

    values = ", ".join(f"('{d}', '{s}')" for d, s in sorted((known() | known_whole()).items()))
    return f"""
WITH known(digest, spdx) AS (VALUES {values}),
line AS (SELECT DISTINCT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents),
unit AS (SELECT doc_id, t, 0 AS whole FROM line UNION ALL SELECT doc_id, coalesce(text, ''), 1 FROM documents),
dig AS (SELECT DISTINCT doc_id, whole, sha256({canon("t")}) AS digest FROM unit)
SELECT doc_id, array_to_string(list_sort(list(DISTINCT spdx)), ',') AS licenses,
       CAST(sum(1 - whole) AS BIGINT) AS n_lines, max(whole) = 1 AS whole_text
FROM dig JOIN known USING (digest) GROUP BY doc_id
"""
