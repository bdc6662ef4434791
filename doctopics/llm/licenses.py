"""Licence scan by canonical digests.

A text is made canonical (lower case, punctuation and spacing to single spaces, copyright lines dropped, equivalent
spellings unified) and looked up whole by its SHA-256 in a table of known licences made canonical the same way. Each line
is looked up like that too, which finds one-line notices inside other texts. Everything is a column expression.

The built-in table has short licences as texts, each with the titles that usual files put above it, file notices, and long
licences as digests of their canonical texts. A line that starts with a copyright statement in any usual form is dropped
("Copyright (c) 2020 A", "Copyright A", "(c) 2020 A", "\u00a9 2020 A", "Portions copyright A"); lines of a licence that merely
start with the word ("copyright notice", "copyright holders") stay. Other texts and variants are a parameter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctopics.runtime import MAX_BROADCAST_ROWS, broadcast_within

# Public licence texts, fixed values.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

{BSD_DISCLAIMER}"""
BSD_3 = BSD_2.replace(
    BSD_DISCLAIMER,
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    f"products derived from this software without specific prior written permission.\n\n{BSD_DISCLAIMER}",
)
MIT_0 = MIT[: MIT.index(", subject to the following")] + ".\n\n" + MIT[MIT.index("THE SOFTWARE IS") :]
X11 = MIT + """

Except as contained in this notice, the name of the copyright holders shall not be used in advertising or otherwise to
promote the sale, use or other dealings in this Software without prior written authorization of the copyright holders."""
BSD_1 = BSD_2[: BSD_2.index("2. Redistributions")] + BSD_DISCLAIMER
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a
source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT
HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS
IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def _gpl_notice(name: str, version: str, later: bool) -> str:
    tail = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation, {tail}.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""


TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT", "License: MIT", "Expat License", "MIT/Expat License"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License", "MIT-0"],
    "X11": ["X11 License", "The X11 License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License", "0BSD", "Zero Clause BSD License", "BSD Zero Clause License (0BSD)"],
    "BSD-1-Clause": ["BSD 1-Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "Revised BSD License", "BSD License", "The BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"],
    "Unlicense": ["The Unlicense", "Unlicense", "The Unlicense (Unlicense)"],
}
BODIES = {
    "MIT": [MIT], "MIT-0": [MIT_0], "X11": [X11], "ISC": [ISC, ISC.replace("and/or distribute", "and distribute")], "0BSD": [ZERO_BSD],
    "BSD-1-Clause": [BSD_1],
    "BSD-2-Clause": [BSD_2, BSD_2.replace("1. Red", "* Red").replace("2. Red", "* Red")],
    "BSD-3-Clause": [BSD_3, BSD_3.replace("1. Red", "* Red").replace("2. Red", "* Red").replace("3. Neither", "* Neither")],
    "Zlib": [ZLIB], "BSL-1.0": [BOOST],
    "Unlicense": [UNLICENSE, *[f"{UNLICENSE}\n\nFor more information, please refer to <{x}>" for x in ("http://unlicense.org/", "https://unlicense.org", "https://unlicense.org/")]],
}
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0.", "Released under the Apache License, Version 2.0.", APACHE_NOTICE, "SPDX-License-Identifier: Apache-2.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "GPL-2.0-only": [_gpl_notice("General Public License", "2", False), "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-2.0-or-later": [_gpl_notice("General Public License", "2", True), "SPDX-License-Identifier: GPL-2.0-or-later"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-3.0-or-later": [_gpl_notice("General Public License", "3", True), "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL-2.1-or-later": [_gpl_notice("Lesser General Public License", "2.1", True), "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL-3.0-or-later": [_gpl_notice("Lesser General Public License", "3", True), "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL-3.0-or-later": [_gpl_notice("Affero General Public License", "3", True), "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "MPL-2.0": [MPL_NOTICE, "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["SPDX-License-Identifier: Unlicense"],
}
# SHA-256 of the canonical public texts of longer licences as their publishers give them, fixed values.
DIGESTS = [
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Apache-2.0", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff"),
    ("Apache-2.0", "6fb8411669deea22294b6190fad00b8e39899d0b7b6c5cf97a3b15b47e129c38"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "9085ee283b8c84517846c5acafee37391c28bb825b7ecec4aaa90768f2f283b0"),
    ("LGPL-2.0", "289c8b47fa0ec7e5f22cd33d32feaa06f015b0f2fdb9ad916979b1011ca8c015"),
    ("LGPL-2.1", "5ddd6039d3b090c51328879800301dd19b1ad99e14d00f3c6f221ab45a32db57"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "c723f1c8033214c990abc66d271f80fce0ec8b02e61de8e6af2f8368a0e6727b"),
    ("MPL-2.0", "4e3ed3db421caff5beab12d8b5ed5c6f8edb888f5430801b1624448d4d7f04fe"),
]


def known_texts() -> list[tuple[str, str]]:
    """``(license_id, text)``: bodies alone and under each title, and notices."""
    out = [(f"notice:{k}", text) for k, texts in NOTICES.items() for text in texts]
    return out + [(k, f"{title}\n\n{body}") for k, bodies in BODIES.items() for body in bodies for title in ["", *TITLES[k]]]


# Patterns mean the same to Java and RE2; they are applied in turn to lower-cased text.
SIGN = "\u00a9"
NOISE = r"[^\p{L}\p{N}\n]+"
# Words after "copyright" that are no name: such a line is part of a licence.
NOT_A_NAME = (
    "holders?|notices?|owners?|laws?|licen[sc]ees?|licen[sc]es?|statements?|interests?|permission|disclaimer|and|or|to|in|is|as|on|"
    "treaty|that|claims?|protection|acts?|rights?|related|ownership|status|registration|infringement|term|works?|the following"
)
SPELLINGS = (
    (r"\blicenc(e|es|ed|ing|ee|ees|or|ors)\b", "licens{1}"),
    (r"\bsub licens", "sublicens"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bwhilst\b", "while"),
    (r"\bnon infring", "noninfring"),
    (r"\bhttps\b", "http"),
)
# (pattern, replacement with {n} for groups)
STEPS = (
    (SIGN, " copyright "),
    (NOISE, " "),
    (rf"(^|\n)( ?)copyright ({NOT_A_NAME})\b", "{1}{2}keptright {3}"),
    (
        r"(^|\n) ?((portions |parts |modifications |additions |original work |modified work )?copyright\b|c [0-9]|c copyright|all rights reserved)[^\n]*",
        "{1}",
    ),
    (r"\bkeptright ", "copyright "),
    *SPELLINGS,
)


def canonical_lines(text: Column) -> Column:
    """Canonical text with its line breaks, spaces around them possible."""
    out = F.lower(text)
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, re.sub(r"\{(\d)\}", r"$\1", new))
    return out


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def digest(canonical: Column) -> Column:
    return F.sha2(one_line(canonical), 256)


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(license_id, text, digest)`` of the built-in licences, or of ``texts`` alone."""
    rows = [(i, t, None) for i, t in (known_texts() if texts is None else texts)]
    rows += [(i, None, d) for i, d in DIGESTS] if texts is None else []
    return spark.createDataFrame(rows, "license_id string, text string, digest string")


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id``, ``text_digest``, ``license_id`` (of the entire text, else null), ``n_notice_lines``, ``notice_ids``.

    ``known`` has ``license_id``, ``text`` and, for texts not at hand, the canonical ``digest``; of several with one canonical
    text the smallest id is taken, and texts with nothing left of them match nothing. ``notice_ids`` joins the different ids
    of matching lines in order; it is empty if there are none. A null text has a null digest. Repeated rows give a row each.
    """
    given = F.col("digest") if "digest" in known.columns else F.lit(None).cast("string")
    digests = known.select("license_id", F.coalesce(given, digest(canonical_lines(F.col("text")))).alias("_d"))
    digests = digests.filter(F.col("_d") != F.sha2(F.lit(""), 256)).groupBy("_d").agg(F.min("license_id").alias("_id"))
    n = known.limit(MAX_BROADCAST_ROWS + 1).count()
    digests = broadcast_within(digests, n)
    units = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), canonical_lines(F.col("text")).alias("_text"))
    lines = F.transform(F.filter(F.split("_text", "\n"), lambda x: F.trim(x) != ""), lambda x: digest(x))
    # the first unit of a document is its whole text, the others are its lines
    units = units.select("doc_id", "_row", F.posexplode(F.array_prepend(F.coalesce(lines, F.array()), digest(F.col("_text")))).alias("_at", "_d"))
    found = units.join(digests, "_d", "left").filter("_at = 0 OR _id IS NOT NULL")
    whole = F.col("_at") == 0
    return found.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(whole, F.col("_d"))).alias("text_digest"),
        F.max(F.when(whole, F.col("_id"))).alias("license_id"),
        F.count(F.when(~whole, F.lit(1))).alias("n_notice_lines"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(~whole, F.col("_id"))))).alias("notice_ids"),
    ).drop("_row")


def _sql_canonical(text: str) -> str:
    out = f"lower({text})"
    for pattern, new in STEPS:
        groups = re.sub(r"\{(\d)\}", lambda m: chr(92) + m[1], new)
        out = f"regexp_replace({out}, '{pattern}', '{groups}', 'g')"
    return out


def _sql_digest(canonical: str) -> str:
    return f"sha256(trim(regexp_replace({canonical}, '[ \\n]+', ' ', 'g'), ' '))"


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in known_texts())
_DIGEST_ROWS = "".join(f" UNION ALL SELECT '{d}', '{i}'" for i, d in DIGESTS)
ORACLE = f"""WITH k AS (SELECT d, min(id) AS id FROM (SELECT {_sql_digest(_sql_canonical('t'))} AS d, i AS id FROM (VALUES {_VALUES}) v(i, t){_DIGEST_ROWS}) GROUP BY 1),
  c AS (SELECT doc_id, {_sql_canonical('text')} AS t FROM documents),
  n AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT k.id, ',' ORDER BY k.id) AS ids
        FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM c) l JOIN k ON {_sql_digest('line')} = k.d
        WHERE trim(line, ' ') <> '' GROUP BY doc_id)
  SELECT c.doc_id, {_sql_digest('t')} AS text_digest, k.id AS license_id, coalesce(n.n, 0) AS n_notice_lines,
    coalesce(n.ids, '') AS notice_ids
  FROM c LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.d = {_sql_digest('t')}"""
