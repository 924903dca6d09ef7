"""Licence scan: canonical text digests, hash-joined to the digests of known licences.

Only DataFrame functions, no shuffle: the known digests are a fixed table of some tens of
rows, so that side of the join is broadcast; documents are scanned once.

Canonical form: lower case, copyright lines cut out, punctuation to blanks, equivalent
spellings unified, blanks collapsed.  Spellings that differ by one letter for another are
unified by ``translate`` (c and z to s: licence, license; organize, organise), the others by plain replacements.  A whole text whose canonical
digest is known is that licence (``license_id``); each line of the canonical text is looked up alike
(``notices``: the ids found, sorted).

Edge cases: null and empty texts have the digest of the empty string and match
nothing; very long texts are whole; repeated rows are answered one by one; an empty table gives none;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line that is a copyright statement and no licence text: with a year, a sign, a name after "by", or a body's name; and the usual phrase after it.
COPYRIGHT = (
    r"(^|\n)[ \t]*([#*/;%-]+[ \t]*)?((copyright|\(c\)|©)[^\n]*[0-9]{4}|copyright[ \t]*(\(c\)|©|:|by[ \t])|©|copyright[ \t]+the[ \t][^\n]*\bauthors\b"
    r"|copyright[ \t][^\n]*\b(inc|llc|ltd|gmbh|corp|corporation|foundation)\b)[^\n]*|\ball[ \t\r\n]+rights reserved\b\.?"
)
#: One character for another: punctuation and blanks but line ends to a blank, c and z to s.
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’–—…©\t\r\x0b\x0c"
FROM, TO = _PUNCTUATION + "cz", " " * len(_PUNCTUATION) + "ss"
#: Spellings that mean the same, in that form (c is s already), in this order: those within a word, and those across blanks.
WORDS = [("ll", "l"), ("our", "or"), ("ogue", "og"), ("dgement", "dgment"), ("programme", "program"), ("whilst", "while"), ("https", "http")]
PHRASES = [("sub lisense", "sublisense"), ("non sommersial", "nonsommersial"), ("per sent", "persent"), ("sopyright holder", "sopyright owner"), ("sopyright owners", "sopyright owner"), ("http ", "")]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = _BSD2.replace("\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
""" + _ISC.split("\n", 1)[1]
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_starred = lambda text: re.sub(r"\n[0-9]\.", "\n*", text)
#: Fixed values: (id, text) of licence texts and of the usual one-line notices.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD2),
    ("BSD-3-Clause", _BSD3),
    ("BSD-2-Clause", _starred(_BSD2)),
    ("BSD-3-Clause", _starred(_BSD3)),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _starred(_BSD3)),
    ("Zlib", _ZLIB),
    ("0BSD", _0BSD),
    ("BSL-1.0", _BSL),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BSL),
    ("Unlicense", _UNLICENSE),
    ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD2),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD3),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


#: Fixed values: (id, digest of the canonical text) of long licences, as their authors publish them; a second one is of the terms without what follows them.
LONG = [
    ("Apache-2.0", "8d3228c6d120eee17b345e9177b54fdec7fe72e7125d078e8f5b8b6a9ff6caf8"),
    ("Apache-2.0", "4006590bff02f1375fc3ec9f6e680a376b945228431da9dae275cd697187f0bb"),
    ("Artistic-1.0-Perl", "7e6e78c0759ee517e0d77c60815473b6cebc68166f37706df5e6b09ba2394512"),
    ("CC0-1.0", "8ff7d76de6f41d1f5ab34557c4de7aa19359d2c0a50b3ffb775d1ce8702c12fb"),
    ("GFDL-1.2", "f096ed105a5ff2408a30e1e745b4f8d953cdc353caba3584c6562ad4439ae04f"),
    ("GFDL-1.3", "a559a17b1c29b7c46a48306c9cb8a537b6236867f7bfddb797ef13ca3ee853c9"),
    ("GPL-1.0", "2e79fd1b31079b7e618e78d46bc5b7065bea9a9d89930bf054a25b2652c6dbcf"),
    ("GPL-1.0", "2c9e090ea437fc33db376bb70814da7097cca552ab64db54cf147cb0d7f0328e"),
    ("GPL-2.0", "f6a71fe199526013ccbc39bdab763a3f0d204ce21467696d28f2a27ff618e760"),
    ("GPL-2.0", "358b320eaaab8c0bc749cc6253ac00e202bb80f780e833e65fcf00946988d199"),
    ("GPL-3.0", "81eb250d2eac81704f6d4aca6b46092bf21c2bd6869da13fcd4b50c35c7b6dd2"),
    ("GPL-3.0", "d8741cfa4c5bb0bd626dd107219e2b28e5204f63ee053a55c0c5c17e783ec14b"),
    ("LGPL-2.0", "aa3a46435710e89c2e0afe2bd8d4e32a72b46b821584cdb40cb2cd07d383e530"),
    ("LGPL-2.0", "d791a7ce8aa94d72a99dcfedc2d618f922ebf4431932ffc68faaf9b02dab37e4"),
    ("LGPL-2.1", "8f20fa1dbed551c8655bb90be60534d6220ec9bfbce12b7e854aa66301f2b7f2"),
    ("LGPL-2.1", "1aa8aabe8025037f6fc80a7de5fc57c95a6d0376d586681338a9662c428fa4f8"),
    ("LGPL-3.0", "35e46971735837b0aa35ccb7430450da00770e96286ddfc2d344612a7807801c"),
    ("MPL-1.1", "43a2f34f58c346aafa87e05f737482b9f0b674a2eb9d9b8b9bb3e84b57c92018"),
    ("MPL-2.0", "6266859dcd154c9d9797df37bb8024ee4ef4f492ced2096628c36b1b25e7c98c"),
    ("BSD-3-Clause-UC", "fbf8eb4e4754ae471ab312f98cac4112e6707752b34e0bbd91129d36a1d49cf0"),
]


def canonical(text: str) -> str:
    """The canonical form of one known text, on the driver; :func:`canonical_columns` has its column form."""
    x = re.sub(COPYRIGHT, "\n", text.lower()).translate(str.maketrans(FROM, TO)).replace("\n", " ")
    for a, b in WORDS:
        x = x.replace(a, b)
    x = re.sub(" {2,}", " ", x)
    for a, b in PHRASES:
        x = x.replace(a, b)
    return x.strip(" ")


def _replaced(x: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def canonical_columns(text: Column) -> tuple[Column, Column]:
    """The canonical form of a whole text, and the array of that of its lines."""
    low = F.lower(text)
    # what every match has in it: few texts need the expression
    may = low.contains("copyright") | low.contains("(c)") | low.contains("©") | low.contains("rights reserved")
    x = F.translate(F.when(may, F.regexp_replace(low, COPYRIGHT, "\n")).otherwise(low), FROM, TO)
    x = F.regexp_replace(_replaced(x, WORDS), " {2,}", " ")
    # line ends are blanks to a whole text; next to others they make runs again
    whole = F.replace(F.replace(F.replace(x, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")), F.lit("\n"), F.lit(" "))
    whole = F.when(whole.contains("  "), F.regexp_replace(whole, " {2,}", " ")).otherwise(whole)
    return F.trim(_replaced(whole, PHRASES)), F.transform(F.split(_replaced(x, PHRASES), "\n", -1), lambda line: F.trim(line))


def known_digests() -> list[tuple[str, str]]:
    """(digest, id), one row a digest, sorted."""
    return sorted(({hashlib.sha256(canonical(t).encode()).hexdigest(): i for i, t in KNOWN} | {d: i for i, d in LONG}).items())


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, canonical_sha256, license_id (of the whole text), notices (ids of its lines)."""
    digests = known_digests()
    known = docs.sparkSession.createDataFrame(digests, "digest string, license_id string")
    by_digest = F.create_map(*[F.lit(x) for pair in digests for x in pair])
    whole, lines = canonical_columns(F.coalesce(F.col("text"), F.lit("")))
    # every line is looked up in the set of digests; few are in it
    found = F.filter(F.transform(lines, lambda x: F.sha2(x, 256)), lambda d: d.isin([d for d, _ in digests]))
    notices = F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: F.element_at(by_digest, d)))), ",")
    hashed = docs.select("doc_id", F.sha2(whole, 256).alias("canonical_sha256"), F.when(notices != "", notices).alias("notices"))
    return hashed.join(F.broadcast(known), hashed.canonical_sha256 == known.digest, "left").select("doc_id", "canonical_sha256", "license_id", "notices")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _quoted(s: str) -> str:
    """A SQL literal; control characters by number."""
    text = "".join(f"' || chr({ord(c)}) || '" if c < " " else c.replace("'", "''") for c in s)
    return f"('{text}')"


def _sql_replaced(x: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


OP7_SQL = f"""
WITH known(digest, license_id) AS (VALUES {", ".join(f"('{d}', '{i}')" for d, i in known_digests())}),
c AS (SELECT doc_id, translate(regexp_replace(lower(coalesce(text, '')), {_quoted(COPYRIGHT)}, chr(10), 'g'), {_quoted(FROM)}, {_quoted(TO)}) x FROM documents),
d AS (SELECT doc_id, regexp_replace({_sql_replaced("x", WORDS)}, ' {{2,}}', ' ', 'g') x FROM c),
l AS (SELECT doc_id, unnest(string_split({_sql_replaced("x", PHRASES)}, chr(10))) line FROM d),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) notices
      FROM (SELECT doc_id, sha256(trim(line, ' ')) digest FROM l) JOIN known USING (digest) GROUP BY doc_id),
w AS (SELECT doc_id, regexp_replace(translate(x, chr(10), ' '), ' {{2,}}', ' ', 'g') x FROM d)
SELECT w.doc_id, w.h canonical_sha256, known.license_id, notices
FROM (SELECT doc_id, sha256(trim({_sql_replaced("x", PHRASES)}, ' ')) h FROM w) w
LEFT JOIN known ON known.digest = w.h LEFT JOIN n USING (doc_id)
"""
