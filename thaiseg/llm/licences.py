"""License scans: canonical digest lookup.

A text is normalised (A-Z folded, lines of copyright statements dropped, runs of ASCII
punctuation and white space to one space, equivalent spellings to one) and the
SHA-256 of the whole result is joined with the digests of known licence texts
and notices, normalised alike.  Every text is looked up whole, and so is each of
its lines, which finds notices inside documents.  The known texts are TEXTS, the
files of licence_texts (with and without what follows the terms), NOTICES and
those that the caller passes: a bounded table, so it is broadcast.

Defined results: null texts count as empty; a text whose normal form is empty
matches nothing; repeated rows are each reported; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import only

# Licence texts and notices as their authors publish them.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
)
_ISC_DENIAL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR '
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT "
    "OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_DENIAL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_HEADS = ("", "All rights reserved.\n\n", "BSD 3-Clause License\n\n", "BSD 3-Clause License\n\nAll rights reserved.\n\n")
TEXTS = {
    "BSD-3-Clause": [head + _BSD + _BSD_THIRD + _BSD_DENIAL for head in _BSD_HEADS],
    "BSD-2-Clause": [head.replace("3", "2") + _BSD + _BSD_DENIAL for head in _BSD_HEADS],
    "MIT": ["MIT License\n\n" + _MIT_GRANT, "The MIT License\n\n" + _MIT_GRANT, _MIT_GRANT],
    "ISC": ["ISC License\n\n" + _ISC_GRANT + _ISC_DENIAL, _ISC_GRANT + _ISC_DENIAL],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_DENIAL],
}

#: Java and DuckDB read these patterns alike: (pattern, replacement with \1).
RULES = [
    # a statement has a sign, a year or "by"; other lines may begin with "copyright" or an item (c)
    (r"(^|\n)[ \t*#/;-]*(copyright[ \t:]*(\(c\)|©|&copy;|by\b|[\[{<(]?([0-9]{4}|yyyy|year)\b)|\(c\)[ \t]*(copyright|by\b|[0-9]{4}\b)|©)[^\n]*", r"\1"),
    (r"[\x00-/:-@\[-`{-\x7f]+", " "),
    (r"\b(sub)?licenc(e|ed|es|ing|ee|or)\b", r"\1licens\2"),
    (r"\b(sub) (licens)", r"\1\2"),
    (r"\b(author|organ|recogn|util|initial|custom)is(e|ed|es|ing|ation)\b", r"\1iz\2"),
    (r"\b(fav|hon|lab|col)our", r"\1or"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bnon (infringement|commercial)", r"non\1"),
    (r"^ | $", ""),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_form(text: str) -> str:
    """The same in Python, for the known texts."""
    out = text.translate(str.maketrans(_UPPER, _LOWER))
    for pattern, to in RULES:
        out = re.sub(pattern, to, out, flags=re.ASCII)
    return out


def normalised(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, re.sub(r"\\(\d)", r"$\1", to))
    return out


def _published() -> Iterator[tuple[str, str]]:
    """(licence, text) of the files, which only the driver reads."""
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        name, text = path.name.removesuffix(".txt").removesuffix(".spdx"), path.read_text()
        terms = text.partition("END OF TERMS AND CONDITIONS")
        for whole in (text, terms[0], terms[0] + terms[1]):
            for web in (whole, whole.replace("https://", "http://"), whole.replace("http://", "https://")):
                yield name, web


def _forms(texts: Mapping[str, Iterable[str]] | None = None) -> list[tuple[str, str]]:
    """(licence, normal form) of all known texts."""
    pairs = [*_published(), *((name, t) for table in (TEXTS, NOTICES, texts or {}) for name, own in table.items() for t in own)]
    return [(name, form) for name, t in pairs if (form := normal_form(t))]


def known(texts: Mapping[str, Iterable[str]] | None = None) -> list[tuple[str, str]]:
    """(digest, licence) of all known texts, and of the caller's ``texts`` by licence."""
    return sorted({hashlib.sha256(form.encode()).hexdigest(): name for name, form in _forms(texts)}.items())


#: Each known form holds one of these, in any spelling that the rules know: other
#: lines can't be among them.
_HINT = r"(?i)licen[cs]|permission|spdx"


def scanned(spark: SparkSession, docs: DataFrame, texts: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """doc_id, digest and licence of the whole text, and of its lines the
    number and the (sorted, distinct) licences of those that are notices.
    ``texts``: more known texts or notices, by licence."""
    table = known(texts)
    which = F.create_map(*[F.lit(x) for row in table for x in row])  # few entries: a scan of them
    docs = only(docs, "doc_id", "text")
    digest = F.sha2(normalised(F.col("text")), 256)
    text = F.coalesce("text", F.lit(""))
    hinted = all(re.search(_HINT, form) for _, form in _forms(texts))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_HINT) if hinted else F.lit(True))
    lines = F.when(text.rlike(_HINT), lines).otherwise(F.array().cast("array<string>")) if hinted else lines
    names = spark.createDataFrame(table, "digest string, license string")
    whole = docs.select("doc_id", digest.alias("digest"), F.filter(F.transform(lines, lambda x: F.element_at(which, F.sha2(normalised(x), 256))), lambda x: x.isNotNull()).alias("n"))
    return whole.join(F.broadcast(names), "digest", "left").select("doc_id", "digest", "license", F.size("n").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("n")), ",").alias("notices"))


def _duck(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    for pattern, to in RULES:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"sha256({out})"


def oracle() -> str:
    rows = ", ".join(f"('{d}', '{n}')" for d, n in known())
    return f"""
    WITH known(digest, license) AS (VALUES {rows}),
    wholes AS (SELECT doc_id, {_duck("text")} AS digest, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    notices AS (SELECT doc_id, license FROM (SELECT doc_id, unnest(lines) AS line FROM wholes) JOIN known ON known.digest = {_duck("line")}),
    counted AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM notices GROUP BY doc_id)
    SELECT w.doc_id, w.digest, k.license, coalesce(c.n, 0) AS n_notices, coalesce(c.notices, '') AS notices
    FROM wholes w LEFT JOIN known k USING (digest) LEFT JOIN counted c USING (doc_id)
    """
