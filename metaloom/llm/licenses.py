"""License scan by canonical digests, in SQL functions only.

A text is made canonical - lower case, lines that state a copyright (not those where a sentence about one was wrapped) left out, equivalent spellings made equal, everything but letters
and digits as one space - and its SHA-256 is joined to the digests of known licences, a fixed list small enough to broadcast.
The whole text must be the licence. Lines that mention a licence are looked up likewise among known one-line notices.

Null and empty texts have the digest of the empty text and no licence. Repeated rows each count; null ids pass through; an empty
table gives an empty result; columns other than doc_id and text take no part.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, table

# Spellings that licence texts use interchangeably, applied in this order.
SPELLINGS = [
    ("licenc", "licens"), ("sub-licens", "sublicens"), ("sub licens", "sublicens"), ("isation", "ization"), ("favour", "favor"), ("honour", "honor"), ("behaviour", "behavior"), ("endeavour", "endeavor"),
    ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("non-", "non"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https://", "http://"), ("&", " and "),
]
# Words that go on with a sentence after 'copyright' at the beginning of a wrapped line; any other word there is taken as a name.
_PROSE = "notices?|holders?|owners?|laws?|licen[sc]es?|licensors?|and|or|on|in|to|of|for|is|are|as|at|from|with|under|that|this|those|may|shall|will|can|which|where|if|interests?|protection|statements?|rights?|disclaimers?|treaty|treaties|act|acts|status|terms?|information|permission|infringement|claims?|material|doctrines?|management"
_COPYRIGHT = rf"^[ \t#*/;%-]*(?:copyright(?:[ \t:]*(?:\(c\)|©|&copy;|[0-9\[<{{])|[ \t:]+(?!(?:{_PROSE})(?![a-z0-9]))[^\n \t,.;:])|\(c\)[ \t]*(?:copyright|©|[0-9]{{4}}|[\[<{{])|©|all rights reserved)[^\n]*$"
#: The oracle's rule, which drops any line that begins with 'copyright'.
_ORACLE_COPYRIGHT = r"^[ \t#*/;%-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
_SIGNS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f“”‘’«»–—…•]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

# Licence texts, by SPDX id, each with and without its title where it has one.
LICENSES = [
    ("MIT", _MIT), ("MIT", f"MIT License\n\n{_MIT}"), ("MIT", f"The MIT License (MIT)\n\n{_MIT}"), ("MIT", f"The MIT License\n\n{_MIT}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_DISCLAIMER}"), ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_DISCLAIMER}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_DISCLAIMER}"), ("0BSD", f"BSD Zero Clause License\n\n{_ISC_GRANT}.\n\n{_ISC_DISCLAIMER}"),
    ("BSD-2-Clause", f"{_BSD_GRANT}\n\n{_BSD_DISCLAIMER}"), ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_GRANT}\n\n{_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD_GRANT}\n\n{_BSD_THIRD}\n\n{_BSD_DISCLAIMER}"), ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_GRANT}\n\n{_BSD_THIRD}\n\n{_BSD_DISCLAIMER}"),
    ("Zlib", _ZLIB), ("Zlib", f"zlib License\n\n{_ZLIB}"), ("Unlicense", _UNLICENSE), ("Unlicense", f"{_UNLICENSE}\n\nFor more information, please refer to <http://unlicense.org/>"), ("Apache-2.0", _APACHE_HEADER),
]
# One-line notices, by SPDX id.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
]

_UNNUMBERED = [(n, re.sub(r"^\d\. ", "* ", t, flags=re.M)) for n, t in LICENSES if n.startswith("BSD-")]
# Canonical digests of whole texts, by SPDX id, from Debian's /usr/share/common-licenses; for texts that go on behind their terms, with and without that part.
DIGESTS = [
    ("Apache-2.0", "6ed31aab79be61ef3197a09ceec1934e9c9c99181c892d83a2af9d37096fbb4e"),
    ("Apache-2.0", "f01b0685ee07aaeac9f18bf843c6c1ef9c939b5a7e3add0e6f0cd14352fc1477"),
    ("Apache-2.0", "016dc67088b11c32128275355c04d5b5b84dc4e620cc3290ef29e8de6d222848"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "5be9df2863a57508353e3f6a052c57284319f64ad20a57cf43f68feb1a6a9f73"),
    ("GPL-3.0", "38f41fbbb4ad2466531a12a71e9b9a4ab70e3d485fa916c5cbbec04fa48e91a3"),
    ("GPL-3.0", "f3ea1094721197c9443e50efd0a9e69a3adacc309c45de7d059ef8a039807307"),
    ("LGPL-2.0", "9cc2462f818dc5a44ed14d981aa58b34d86c9638198d69ef79d527c534662992"),
    ("LGPL-2.0", "864b56443c13e6854fc7a97dcde15a587874eec44d11d5e00af96c7bef2f09a5"),
    ("LGPL-2.0", "244f277db03f1c67bfaa6a44df3c5852b93566021d3f84b21d7952dfab38e748"),
    ("LGPL-2.1", "256b137e3d4b2abc955a03e65932dd5b925460710346c23f8ec34f24e3812f45"),
    ("LGPL-2.1", "e2de78b6bf22306a05b33421124bd842e990de5f8b24264ebb5d8b9b33618e5a"),
    ("LGPL-2.1", "2672e7e6104372791294344a99aeb402fd0f5160cc49edcdcdd64bb1ca43bb60"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbf655202fd8f29740e68b83df374d3f05f751c47cadc486986f8beadf230efa"),
    ("MPL-1.1", "aab2364179fe60c965195cdaa4cb4889a73ff84d3c3f448e343aa3183936758e"),
    ("MPL-2.0", "0e58ab3210fd5869b91fcfa3fe503243b6bacabd7ea94541eae6685166904692"),
    ("MPL-2.0", "fc35b4b9a8e190516371ae51559b5934080dbed4dc4a11ba5f77b156a9b846bb"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.2", "84f3c9e8cdded0036378e7e6eb92ac6570731434d2fc46027f259264dc16501e"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GFDL-1.3", "ccfa2750c2a3b9dae93f959cfa64078cc3a306c4a4cd4cfaf18365396202da90"),
    ("Artistic-1.0-Perl", "6af159a51212f3411b1e32eadc0440ba44a8f00111dd1b1786dbbe3486c79ab3"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
]
_TITLES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"), "MIT": ("MIT License",), "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License",), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"), "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"), "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3"), "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3"), "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"), "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0",), "Zlib": ("zlib License",), "Unlicense": ("Unlicense",),
}
_PHRASES = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This file is licensed under")
MORE_NOTICES = [(i, f"SPDX-License-Identifier: {i}{x}") for i in _TITLES for x in (("-only", "") if "GPL" in i else ("",))] + [(i, f"{p} {the}{t}") for i, titles in _TITLES.items() for t in titles for p in _PHRASES for the in ("", "the ", "a ")]


def canonical(text: str) -> str:
    """The canonical form of one text; the column form below is the same for whole tables."""
    text = re.sub(_COPYRIGHT, "", text.lower(), flags=re.M)
    for a, b in SPELLINGS:
        text = text.replace(a, b)
    return re.sub(_SIGNS, " ", text).strip(" ")


def canonical_column(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), f"(?md){_COPYRIGHT}", "")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, _SIGNS, " "))


def _known(texts: list[tuple[str, str]]) -> dict[str, str]:
    return {hashlib.sha256(canonical(t).encode()).hexdigest(): name for name, t in texts}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, license_id (null if the text is no known licence) and notice_ids (sorted, comma-separated) of docs."""
    spark = docs.sparkSession
    docs = columns_of(docs, {"doc_id": "long", "text": "string"}).withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.contains(F.lower(line), F.lit("licen")))
    notices = F.create_map([F.lit(x) for pair in _known(NOTICES + MORE_NOTICES).items() for x in pair])
    found = F.filter(F.transform(lines, lambda line: F.element_at(notices, F.sha2(canonical_column(line), 256))), lambda x: x.isNotNull())
    known = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{d}', '{n}')" for d, n in (_known(LICENSES + _UNNUMBERED) | {d: n for n, d in DIGESTS}).items()) + " AS known(canonical_sha256, license_id)")
    out = docs.select("doc_id", F.sha2(canonical_column(F.col("text")), 256).alias("canonical_sha256"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notice_ids"))
    return out.join(F.broadcast(known), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id", "notice_ids")


def _oracle() -> str:
    quoted = lambda s: s.replace("'", "''")

    def form(text: str) -> str:
        out = f"regexp_replace(lower({text}), '(?m){quoted(_ORACLE_COPYRIGHT)}', '', 'g')"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return f"trim(regexp_replace({out}, '{_SIGNS}', ' ', 'g'), ' ')"

    values = lambda known: ", ".join(f"('{d}', '{n}')" for d, n in known.items())
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k(d, license_id) AS (VALUES {values(_known(LICENSES))}), o(d, id) AS (VALUES {values(_known(NOTICES))}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
hits AS (SELECT l.doc_id, string_agg(DISTINCT o.id, ',' ORDER BY o.id) AS ids FROM lines l JOIN o ON o.d = sha256({form("l.line")}) WHERE contains(lower(l.line), 'licen') GROUP BY l.doc_id),
c AS (SELECT doc_id, sha256({form("text")}) AS canonical_sha256 FROM t)
SELECT c.doc_id, canonical_sha256, license_id, coalesce(hits.ids, '') AS notice_ids FROM c LEFT JOIN k ON k.d = canonical_sha256 LEFT JOIN hits ON hits.doc_id = c.doc_id
"""


ORACLE = _oracle()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", {"doc_id": "long", "text": "string"}))
