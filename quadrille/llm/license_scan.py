"""Licence scan: canonical digest lookup (operator 6, DataFrame functions only).

The whole text is brought to a canonical form - lower case, no copyright lines, only
letters and digits, equivalent spellings made one, so that wrapping and comment marks don't
count - and its SHA-256 is looked up in the
table of known licences by a hash join. The known side has one row for each text below, a
bound fixed by this module, so it is broadcast; the document side is a map-only scan.

Defined cases: null or blank text has the digest of the empty string and no licence; a
text that only holds copyright lines likewise; repeated rows each get a row.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that count as equal, wherever they stand.
SPELLINGS = {
    "licenc": "licens",
    "sub licens": "sublicens",
    "non infringement": "noninfringement",
    "merchantibility": "merchantability",
    "organisation": "organization",
    "authorisation": "authorization",
    "favour": "favor",
    "copyright owner": "copyright holder",
    "https": "http",
}

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, '
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
    "For more information, please refer to <https://unlicense.org>"
)
#: Whole texts in ``licenses``.
WHOLE = {"Apache-2.0": "Apache-2.0", "GPL-2.0-only": "GPL-2", "GPL-3.0-only": "GPL-3", "LGPL-2.1-only": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
# The known licences, as published, and the notices that stand for one.
LICENSES = [
    ("MIT", "MIT License\n" + _MIT + _WARRANTY),
    ("MIT", _MIT + _WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD + _BSD_WARRANTY),
    ("BSD-2-Clause", _BSD + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD + _BSD_THIRD + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_WARRANTY),
    ("ISC", "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", _UNLICENSE),
    *((name, files("quadrille.llm").joinpath("licenses", f"{file}.txt").read_text("utf-8")) for name, file in WHOLE.items()),
]
#: What may lead a line of a notice: blanks and marks of comments.
_LEAD = r"(?m)^([ \t#*/;-]*)"
#: Lines that begin with "copyright" but go on with the licence's own words.
OWN_WORDS = _LEAD + r"(copyright[ \t]+(?:notices?|holders?|owners?|laws?|licen[sc]es?|disclaimers?|statements?|interests?|protection|treaty|treaties|and|or|in|is|to|under|of|for|that|the terms|permission|as)\b)"
#: A line that states a copyright and no more, or the reservation that follows it.
COPYRIGHT_LINE = _LEAD + r"(?:copyright\b|\(c\)[ \t]*(?:copyright|[0-9]{4})|\x{a9}|all rights reserved\.?[ \t]*$)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Canonical form of a licence text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, OWN_WORDS, "=$2")  # no longer begins with the word
    t = F.regexp_replace(t, COPYRIGHT_LINE, " ")
    t = F.trim(F.regexp_replace(t, NOT_WORD, " "))
    for spelt, as_ in SPELLINGS.items():
        t = F.replace(t, F.lit(spelt), F.lit(as_))
    return t


def known_digests(spark) -> DataFrame:
    """license_id, digest of each known text; one row for each digest."""
    table = spark.createDataFrame(LICENSES, "license_id string, body string")
    return table.select("license_id", F.sha2(canonical(F.col("body")), 256).alias("digest")).dropDuplicates(["digest"])


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest of the canonical text and license_id
    (null where the text as a whole is no known licence)."""
    rows = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return rows.join(F.broadcast(known_digests(docs.sparkSession)), "digest", "left").select("doc_id", "digest", "license_id")
