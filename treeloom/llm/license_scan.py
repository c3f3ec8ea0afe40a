"""Licence scan by canonical digest lookup.

A text is normalised once (case, copyright lines, punctuation, equivalent
spellings), with its line ends and blank lines kept as marks, and cut into
units: the whole text, its blocks between blank lines, and its lines. The
SHA-256 digest of each unit's normal form is joined to the digests of known
licences and notices; units are looked up entire, never searched for fragments.
Everything is built-in expressions, so there is no shuffle and no Python; the
table of known digests is small and fixed (``known``), and is broadcast only
below ``BROADCAST_ROWS``; a caller's own table takes the same way.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
#: Marks of a line that was a copyright line, and of a blank line, within a text.
DROPPED, BLANK = "\x01", "\x02"

#: (pattern, Java replacement) in order, applied to lower-case text without marks; the dialect is common to Java, RE2
#: and Python. Line ends stay, so that units can be cut afterwards; what spans them keeps them.
STEPS: list[tuple[str, str]] = [
    (r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©|<year>|\[year\])[^\n]*", "$1" + DROPPED),
    (r"\n[ \t\r]*\n", "\n" + BLANK + "\n"),
    (r"[^a-z0-9\n\x02]+", " "),
    (r"\ball([ \n]+)rights([ \n]+)reserved\b", "$1$2"),
    (r"\bhttps\b", "http"),
    (r"\bv(ersion|er)?([ \n]*)([0-9])", "version$2 $3"),
    (r"licenc", "licens"),
    (r"is(e|ed|es|ing|ation|ations)\b", "iz$1"),
    (r"our(s|ed|able)?\b", "or$1"),
    (r"dgement", "dgment"),
    (r"\bwhilst\b", "while"),
    (r"\b(wil|fulfil)(ful|led|ling|s)?\b", "$1l$2"),
    (r"\b(owners?|holders)\b", "holder"),
    (r"\bnon([ \n]+)commercial\b", "$1noncommercial"),
]


def normal_text(text: str) -> str:
    """The normal form of a text with its marks, in Python, for known texts and tests."""
    t = text.lower().replace(DROPPED, " ").replace(BLANK, " ")
    for p, r in STEPS:
        t = re.sub(p, lambda m, r=r: re.sub(r"\$(\d)", lambda d: m[int(d[1])] or "", r), t)
    return t


def canonical_text(text: str) -> str:
    """The normal form of a text as a unit."""
    return re.sub("[ \n\x02]+", " ", normal_text(text)).strip(" ")


def normal(c: Column) -> Column:
    """The normal form with its marks as an expression."""
    t = F.translate(F.lower(c), DROPPED + BLANK, "  ")
    for p, r in STEPS:
        t = F.regexp_replace(t, p, r)
    return t


def flat(c: Column) -> Column:
    """A part of a normal form as a unit."""
    return F.trim(F.regexp_replace(c, r"[ \n\x02]+", " "))


def _sql_string(s: str) -> str:
    """A string as SQL; control characters by number."""
    parts = re.split(r"([\x00-\x1f])", s)
    return "(" + " || ".join(f"chr({ord(x)})" if len(x) == 1 and x < " " else "'" + x.replace("'", "''") + "'" for x in parts if x) + ")"


def normal_sql(c: str) -> str:
    t = f"translate(lower({c}), chr(1) || chr(2), '  ')"
    for p, r in STEPS:
        t = f"regexp_replace({t}, '{p}', {_sql_string(re.sub(r'[$](\d)', r'\\\1', r))}, 'g')"
    return t


def flat_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '[ \\n\\x02]+', ' ', 'g'), ' ')"


_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def _gnu(name: str, version: int) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""


_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
FULL: dict[str, list[str]] = {
    "MIT": [_MIT, "MIT License\n\n" + _MIT, "The MIT License (MIT)\n\n" + _MIT, "The MIT License\n\n" + _MIT],
    "ISC": [x + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY for x in ("", "ISC License\n\n")],
    "0BSD": [x + _ISC_GRANT + ".\n\n" + _ISC_WARRANTY for x in ("", "BSD Zero Clause License\n\n")],
    "BSD-2-Clause": [x + _BSD_HEAD + "\n" + _BSD_TAIL for x in ("", "BSD 2-Clause License\n\n")],
    "BSD-3-Clause": [x + _BSD_HEAD + "\n" + _BSD_THIRD + "\n" + _BSD_TAIL for x in ("", "BSD 3-Clause License\n\n")],
    "Apache-2.0": [_APACHE],
    "Zlib": [_ZLIB, "zlib License\n\n" + _ZLIB],
    "Unlicense": [_UNLICENSE],
    "BSL-1.0": [_BOOST, "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST],
    "MPL-2.0": [_MPL],
    "GPL-3.0-or-later": [_gnu(_GPL, 3)],
    "GPL-2.0-or-later": [_gnu(_GPL, 2)],
    "LGPL-3.0-or-later": [_gnu(_LGPL, 3)],
    "AGPL-3.0-or-later": [_gnu(_AGPL, 3)],
}
#: Digests of the canonical forms of full texts that are too long to stand here; Apache-2.0 with its appendix and without.
FULL_DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": ["6a1be63a0cc15f72bd166512e80224c4dcf6752f41b298e09dae3f14050b34ce", "7cb8df43b3c2800e3c1adeb1bc8c43c666bd30db3509e66524f340aabdf42145"],
    "GPL-2.0": ["cb154ab9b0a51a9ac10a614acd9760a876cbf72c8a6a8dc759580405b37042dd"],
    "GPL-3.0": ["71cd201f1b5f85e6465eb2456974a5bcdf1cb77422c3ef6a35eeb51b3bd424b3"],
    "LGPL-2.1": ["21c8ff76180df5685ec117875d2f9a4349c9e0f25dd4f19ca68f644e9b9bae6c"],
    "LGPL-3.0": ["f9971a40b39b55b23a81e443f25bde5afd88dcddc5a97e859f3e234c6409bb34"],
    "MPL-2.0": ["fb147075ff9773931d4af935baf522ee20075611ff7b60c8b861873f23e1839c"],
    "CC0-1.0": ["82c14200990032ffb6fcd1a421750e47ceb0eae4dac7c35ebc1cc250a01811f7"],
}
#: Names by which one-line notices call a licence.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache-2.0", "Apache 2.0"],
    "GPL-3.0": [_GPL + ", version 3", _GPL + " version 3", _GPL + " 3.0", "GNU GPL v3", "GPLv3", "GPL v3", "GPL-3.0"],
    "GPL-2.0": [_GPL + ", version 2", _GPL + " version 2", "GNU GPL v2", "GPLv2", "GPL v2", "GPL-2.0"],
    "LGPL-3.0": [_LGPL + ", version 3", "GNU LGPL v3", "LGPL-3.0"],
    "AGPL-3.0": [_AGPL + ", version 3", "GNU AGPL v3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "Unlicense": ["Unlicense"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
}
_VERBS = [a + b + " under" for a in ("", "this work is ", "this file is ", "this program is ", "this software is ", "this project is ", "code ", "content ") for b in ("licensed", "released", "distributed", "available", "made available", "dual licensed")]


def known() -> list[tuple[str, str]]:
    """(digest, license_id) of the canonical forms of all known texts and notices."""
    texts: dict[str, str] = {}
    for lic, full in FULL.items():
        for t in full:
            texts[canonical_text(t)] = lic
    for lic, names in NAMES.items():
        for n in names:
            for v in _VERBS:
                for the in ("", "the ", "the terms of the ", "a "):
                    texts.setdefault(canonical_text(f"{v} {the}{n}"), lic)
        texts.setdefault(canonical_text(f"SPDX-License-Identifier: {lic}"), lic)
        for n in names:
            if n.lower().endswith("license") or "license," in n.lower():
                texts.setdefault(canonical_text(n), lic)
                texts.setdefault(canonical_text("The " + n), lic)
    texts.pop("", None)
    return sorted([*((hashlib.sha256(t.encode()).hexdigest(), lic) for t, lic in texts.items()), *((d, lic) for lic, ds in FULL_DIGESTS.items() for d in ds)])


def scan(docs: DataFrame, digests: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """doc_id, unit, unit_no, license_id, digest: the units of each row that are a known text.

    unit is ``text`` (the whole text, unit_no 0), ``block`` (between blank
    lines) or ``line``, numbered from 0; blocks and lines are units where there
    is more than one. Null texts have no unit; a unit with no letter or digit
    (an empty text, say) matches nothing; a null doc_id stays null; repeated
    rows repeat their results; an empty table gives no row; texts of any length
    are read entire. Other columns are ignored, whatever their names.
    ``digests`` is a caller's own table (digest, license_id) in place of
    ``known()``; it may be a DataFrame of any size. Of a digest with several
    licences the first one by name counts.
    """
    spark = docs.sparkSession
    if isinstance(digests, DataFrame):
        table, small = digests.select("digest", "license_id"), False
    else:
        rows = known() if digests is None else digests
        table, small = spark.createDataFrame(rows, "digest string, license_id string").coalesce(1), len(rows) <= BROADCAST_ROWS
    table = table.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    none = F.array().cast("array<struct<unit: string, unit_no: int, u: string>>")

    def many(parts: Column, name: str) -> Column:
        return F.when(F.size(parts) > 1, F.transform(parts, lambda u, i: F.struct(F.lit(name).alias("unit"), i.alias("unit_no"), u.alias("u")))).otherwise(none)

    # A range of one value keeps the optimizer from copying the normal form into each of its uses.
    base = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(normal(F.col("text").cast("string")))).alias("text"))
    whole = F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("unit_no"), F.col("text").alias("u")))
    units = base.select("doc_id", F.explode(F.concat(whole, many(F.split("text", f"\n{BLANK}\n"), "block"), many(F.split("text", "\n"), "line"))).alias("x"))
    units = units.select("doc_id", "x.unit", "x.unit_no", F.sha2(flat(F.col("x.u")), 256).alias("digest"))
    return units.join(F.broadcast(table) if small else table, "digest").select("doc_id", "unit", "unit_no", "license_id", "digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences and notices in all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    values = ", ".join(f"('{d}', '{lic}')" for d, lic in known())
    return f"""
WITH known(digest, license_id) AS (VALUES {values}),
normal AS MATERIALIZED (SELECT doc_id, {normal_sql('text')} AS text FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, string_split(text, chr(10) || chr(2) || chr(10)) AS b FROM normal),
units AS (
  SELECT doc_id, 'text' AS unit, 0 AS unit_no, text AS u FROM parts
  UNION ALL
  SELECT doc_id, 'block', unnest(range(len(b)))::INTEGER, unnest(b) FROM parts WHERE len(b) > 1
  UNION ALL
  SELECT doc_id, 'line', unnest(range(len(l)))::INTEGER, unnest(l) FROM parts WHERE len(l) > 1),
hashed AS (SELECT doc_id, unit, unit_no::INTEGER AS unit_no, sha256({flat_sql('u')}) AS digest FROM units)
SELECT doc_id, unit, unit_no, license_id, digest FROM hashed JOIN known USING (digest)
"""
