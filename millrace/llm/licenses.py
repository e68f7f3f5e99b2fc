"""Licence scans by canonical digests.

Texts are brought to a canonical form and the digests of whole texts are joined with those of known licences. The same licences are
found inside other text: where a line begins as a known licence does, the run of words of that licence's length is looked up too.
Notices of one line or paragraph are an extra, looked up among digests of generated sentences.

Whole texts known: the short ones below, and long ones as digests in ``license_digests.json``, which ``python -m millrace.llm.licenses
FOLDER`` writes from a folder of licence texts named by licence.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line that names a holder or a year, not one that goes on with "copyright notice" or the like.
_COPYRIGHT = re.compile(r"^\W*(?:portions\s+(?:are\s+)?)?(?:(?:copyright|copr)\b(?=.*(?:\(c\)|©|\b\d{4}\b|\[yyyy\]|<year>|\[year\]))|(?:copyright|copr)\s+by\b|\(c\)\s|©)|^\W*all rights reserved\W*$", re.I)
_MARKS = re.compile(r"[\W_]+")

# Spellings that licence matching treats as one.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense", "organisation": "organization",
    "organisations": "organizations", "authorisation": "authorization", "authorised": "authorized", "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments",
    "favour": "favor", "honour": "honor", "fulfil": "fulfill", "fulfilment": "fulfillment", "judgement": "judgment", "recognise": "recognize", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful", "cancelled": "canceled", "initialise": "initialize", "analogue": "analog", "centre": "center", "catalogue": "catalog",
    "v1": "version 1", "v2": "version 2", "v3": "version 3", "https": "http",
}

# Short names of licences and the names that notices use for them.
NAMES = {
    "MIT": ("MIT License", "Expat License", "X11 License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL version 2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL version 3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "Unlicense": ("Unlicense",),
    "EPL-2.0": ("Eclipse Public License 2.0", "EPL-2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
VERBS = ("licensed", "released", "distributed", "published", "available", "made available")
SUBJECTS = ("", "this work is ", "this text is ", "this document is ", "this file is ", "this program is ", "this software is ", "this project is ", "content is ", "this content is ", "the code is ")

# Title lines that stand before short texts.
TITLES = ("MIT License", "The MIT License", "The MIT License (MIT)", "Expat License", "ISC License", "The ISC License", "BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "zlib License", "The zlib License", "Boost Software License", "BSD Zero Clause License")

# Whole licence texts, without titles and copyright lines.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to "
        "do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS + " IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone "
        "to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
    ),
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law.\n" + _AS_IS + " IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <https://unlicense.org>"
    ),
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is "
        "furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be "
        "included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by "
        "a source language processor.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}

# The notice that files under a licence carry.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n"
        "http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
}
DIGESTS = Path(__file__).with_name("license_digests.json")
#: A known text is looked up where a line begins with so many of its first words.
HEAD_WORDS = 5


def canonical_line(line: str) -> str:
    """Lower case, known spellings, words only; a copyright line is empty."""
    if _COPYRIGHT.match(line):
        return ""
    return " ".join(SPELLINGS.get(w, w) for w in _MARKS.sub(" ", line.casefold()).split())


def digest(canonical: str) -> bytes:
    return hashlib.sha256(canonical.encode()).digest()


@functools.cache
def _titles() -> frozenset[str]:
    return frozenset(map(canonical_line, TITLES))


def canonical_lines(text: str) -> list[str]:
    """Canonical lines that aren't empty; a title before all others is left out if more follows."""
    lines = [x for x in map(canonical_line, text.split("\n")) if x]
    return lines[1:] if len(lines) > 1 and lines[0] in _titles() else lines


def canonical(text: str) -> str:
    return " ".join(canonical_lines(text))


@functools.cache
def whole_digests() -> dict[bytes, tuple[str, int, tuple[str, ...]]]:
    """Of whole licence texts: digest to name, number of words and first words."""
    found = {}
    for name, text in TEXTS.items():
        w = canonical(text).split(" ")
        found[digest(" ".join(w))] = (name, len(w), tuple(w[:HEAD_WORDS]))
    for own in json.loads(DIGESTS.read_text()):
        found[bytes.fromhex(own["sha256"])] = (own["license"], own["words"], tuple(own["first"]))
    return found


@functools.cache
def notice_digests() -> dict[bytes, str]:
    """Of notices, a line or a paragraph long: a sentence for every subject, verb and name."""
    found = {digest(canonical(text)): name for name, text in NOTICES.items()}
    for name, own in NAMES.items():
        for called in own:
            found.setdefault(digest(canonical_line(called)), name)
            found.setdefault(digest(canonical_line(f"SPDX-License-Identifier: {name}")), name)
            for verb in VERBS:
                for subject in SUBJECTS:
                    for article in ("the ", "a ", "an ", ""):
                        found.setdefault(digest(canonical_line(f"{subject}{verb} under {article}{called}")), name)
    return found


def known_licenses(spark: SparkSession) -> DataFrame:
    """``(digest, license, whole)``; its size is that of the lists above, whatever the input."""
    rows = [(d, name, True) for d, (name, _, _) in whole_digests().items()] + [(d, name, False) for d, name in notice_digests().items()]
    return spark.createDataFrame(rows, "digest binary, license string, whole boolean")


@functools.cache
def _heads() -> dict[tuple[str, ...], tuple[int, ...]]:
    """First words of known texts to their numbers of words."""
    found: dict[tuple[str, ...], set[int]] = {}
    for _, n, first in whole_digests().values():
        found.setdefault(first, set()).add(n)
    return {k: tuple(sorted(v)) for k, v in found.items()}


def _units(text: str) -> list[tuple[str, bytes]]:
    """The whole text, its paragraphs and lines, and the runs of lines that may be a known text."""
    rows = [("text", digest(canonical(text)))]
    words: list[str] = []
    ends, starts = set(), []
    paragraph = 0
    for line in [*text.split("\n"), ""]:
        if not line.strip():
            if len(starts) - paragraph > 1:
                rows.append(("paragraph", digest(" ".join(words[starts[paragraph] :]))))
            paragraph = len(starts)
            continue
        own = canonical_line(line)
        if own:
            rows.append(("line", digest(own)))
            starts.append(len(words))
            words.extend(own.split(" "))
            ends.add(len(words))
    heads = _heads()
    for at in starts:
        for n in heads.get(tuple(words[at : at + HEAD_WORDS]), ()):
            if at + n in ends and n < len(words):
                rows.append(("run", digest(" ".join(words[at : at + n]))))
    return rows


def text_units(docs: DataFrame) -> DataFrame:
    """``(key, key2, unit, digest, times)`` of rows ``(key, key2, text)``: canonical digests of each whole text and of its parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), 500):
                part = b.iloc[start : start + 500]
                found = [(k, k2, *row, n) for k, k2, text in zip(part["key"], part["key2"], part["text"], strict=True) for row, n in Counter(_units(text)).items()]
                yield pd.DataFrame(found, columns=["key", "key2", "unit", "digest", "times"])

    return docs.mapInPandas(run, "key long, key2 long, unit string, digest binary, times long")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row: ``doc_id, license, contains, notices, n_notices``.

    ``license`` is the licence that the whole text is (null if none), but for case, punctuation, copyright lines, spellings and a
    title; ``contains`` the distinct licences whose whole texts stand somewhere inside, ``notices`` those that its lines and paragraphs
    speak of, both in alphabetical order, joined by commas (empty if none), and ``n_notices`` how many lines and paragraphs do. A null
    text counts as empty. Repeated rows are scanned alike, null ids too. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit("second"), text).alias("key2"))
    known = F.broadcast(known_licenses(docs.sparkSession))  # a fixed list
    hits = text_units(rows.select("key", "key2", "text")).join(known, "digest").where(F.col("whole") == F.col("unit").isin("text", "run"))
    of = lambda unit: F.array_join(F.array_sort(F.collect_set(F.when(unit, F.col("license")))), ",")
    notice = ~F.col("whole")
    found = hits.distinct().groupBy("key", "key2").agg(
        F.max(F.when(F.col("unit") == "text", F.col("license"))).alias("license"), of(F.col("unit") == "run").alias("contains"), of(notice).alias("notices"), F.sum(F.when(notice, F.col("times"))).alias("n_notices")
    )
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    out = rows.select("doc_id", "key", "key2").join(found, ["key", "key2"], "left")
    return out.select("doc_id", "license", empty("contains"), empty("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def write_digests(folder: str) -> None:
    """``license_digests.json`` from the files of a folder, each a whole licence text named by its licence.

    Where a text goes on after its terms with advice on their use, the terms alone are known as well.
    """
    found = []
    for file in sorted(Path(folder).iterdir()):
        if file.is_symlink() or file.name in TEXTS or not file.is_file():
            continue
        text = file.read_text("utf-8", "replace")
        ends = [m.start() for m in re.finditer(r"^\W*END OF TERMS AND CONDITIONS\W*$", text, re.M)]
        for part in dict.fromkeys([text, *(text[: text.index("\n", e)] for e in ends)]):
            w = canonical(part).split(" ")
            found.append({"license": file.name, "words": len(w), "first": w[:HEAD_WORDS], "sha256": digest(" ".join(w)).hex()})
    DIGESTS.write_text(json.dumps(found, indent=1) + "\n")


if __name__ == "__main__":
    write_digests(sys.argv[1])
