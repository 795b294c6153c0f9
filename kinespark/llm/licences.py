"""License scans: canonical digests of whole texts, joined to the digests of known licences.

The canonical form of a text: lower case, equivalent spellings made one, copyright lines and "all rights reserved"
dropped, and each run of characters other than a-z and 0-9 turned into one space. Its SHA-256 is hash-joined to a table
of the digests of known texts and notices. A whole document is one text; so is each of its lines, which finds notices
inside documents.

Defined results: a null text has the digest of the empty one, which is no licence; a text of copyright lines only, too;
very long texts and lines are digested whole; a licence named in several lines is listed once and counted for each;
repeated rows each get their result; an empty table gives an empty result; other columns, of whatever names, are ignored.

Scale: one pass over the texts; only whole digests and the lines that are known notices are shuffled, by row. The table
of known digests is a constant of this module (a few hundred rows) and the caller's texts, at most MOST_KNOWN rows,
which bounds what is broadcast.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold

#: Spellings that count as one; fixed values.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("merchantibility", "merchantability"), ("http:", "https:"), ("(c)", "copyright"), ("©", "copyright"))

#: Known texts by name; fixed values.
WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. '
NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
NO_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
DISCLAIMED = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = {"MIT": MIT + WARRANTY, "BSD-2-Clause": BSD + DISCLAIMED, "BSD-3-Clause": BSD + NO_NAMES + DISCLAIMED, "ISC": ISC + NO_WARRANTY, "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + NO_WARRANTY}
#: Names that notices give to licences; fixed values.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0 License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
}
FORMS = ("{}", "{}.", "Licensed under the {}", "Licensed under {}", "This work is licensed under the {}", "This work is licensed under {}", "This work is licensed under a {}", "Released under the {}", "Released under {}", "Distributed under the {}", "License: {}", "Available under the {}")

#: Digests of the canonical form of whole public texts too long to state here; fixed values.
LONG_TEXTS = {
    "3c93005c1361582a748bd291a4ae484ba70108e2075fec9a011ec57572f4fcbf": "Apache-2.0",
    "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2": "Artistic-1.0",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71": "GFDL-1.2",
    "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6": "GFDL-1.3",
    "490a17f9c44b8e7737e6d5b52eebf4c3610f67ee98c4ad515329fa012eebe42d": "GPL-1.0",
    "2d0b5e012e036a2690fe078a56f4c6dabcb7e2c352ef799e5e2074dab15ef4ae": "GPL-2.0",
    "e26dd02b6f171847fff8990d6b6dc203840c1fee6353a67994f4e5ff939d88eb": "GPL-3.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "40e733b7cd519486ddb52070e5798f4e73066b593a35c58ede32a4e9b3494dff": "MPL-1.1",
    "c6a506eb968bd2cfbb1ea819736390e6ef797bab6d08beb74875c8a0dbc1d917": "MPL-2.0",
}
MOST_KNOWN = 100_000

_COPYRIGHT = "(^|\\n)[^a-z0-9\\n]*copyright[ ,:]*(copyright|by |[0-9<{(]|\\[)[^\\n]*"


def lines_of(text: str) -> list[str]:
    """The canonical form of each line, without empty ones; joined by a space they are the whole text's."""
    out = text.lower()
    for old, new in SPELLINGS:
        out = out.replace(old, new)
    out = re.sub(_COPYRIGHT, "\\1 ", out).replace("all rights reserved", " ")
    return [x for line in re.sub("[^a-z0-9\\n]+", " ", out).split("\n") if (x := line.strip(" "))]


def canonical(text: str) -> str:
    """The canonical form, as the SQL below has it."""
    return " ".join(lines_of(text))


def digests(more: dict[str, str] | None = None) -> dict[str, str]:
    """Digest to licence, of all known texts and notices, and of the caller's own (name to text)."""
    known = [(k, t) for k, t in TEXTS.items()] + [(k, f.format(n)) for k, names in NAMES.items() for n in names for f in FORMS] + list((more or {}).items())
    out = LONG_TEXTS | {hashlib.sha256(canonical(t).encode()).hexdigest(): k for k, t in known}
    if len(out) > MOST_KNOWN:
        raise ValueError(f"{len(out)} known texts; at most {MOST_KNOWN} are sent to executors")
    return out


def _canonical_lines(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.replace(F.regexp_replace(out, _COPYRIGHT, "$1 "), F.lit("all rights reserved"), F.lit(" "))
    out = F.transform(F.split(F.regexp_replace(out, "[^a-z0-9\\n]+", " "), "\n"), lambda x: F.trim(x))
    return F.array_remove(out, "")


def scan(docs: DataFrame, more: dict[str, str] | None = None) -> DataFrame:
    """One row a document: doc_id, digest, licence (of the whole text, or null), notices (the distinct licences of its
    lines, sorted and comma-joined) and n_notices (lines that are known notices)."""
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(sorted(digests(more).items()), "_known string, licence string"))
    # The number of a row of a scan is the same when a lost task runs again.
    rows = hold(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_r")), _lines=_canonical_lines(F.col("text")))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    rows = hold(rows.drop("text"), digest=sha(F.array_join("_lines", " ")), _d=F.transform("_lines", sha))
    every = rows.select("_r", "doc_id", "digest", F.posexplode(F.concat(F.array("digest"), F.col("_d"))).alias("_at", "_digest"))
    found = every.join(known, F.col("_digest") == F.col("_known"), "left").filter("_at = 0 or licence is not null")
    line = F.when(F.col("_at") > 0, F.col("licence"))
    out = found.groupBy("_r").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("digest").alias("digest"),
        F.max(F.when(F.col("_at") == 0, F.col("licence"))).alias("licence"),
        F.array_join(F.array_sort(F.collect_set(line)), ",").alias("notices"),
        F.count(line).alias("n_notices"),
    )
    return out.drop("_r")


def sql() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"lower({x})"
        for old, new in SPELLINGS:
            out = f"replace({out}, {quote(old)}, {quote(new)})"
        out = f"replace(regexp_replace({out}, {quote(_COPYRIGHT)}, '\\1 ', 'g'), 'all rights reserved', ' ')"
        return f"regexp_replace({out}, '[^a-z0-9\\n]+', ' ', 'g')"

    known = ", ".join(f"({quote(d)}, {quote(k)})" for d, k in sorted(digests().items()))
    return f"""
WITH known(digest, licence) AS (VALUES {known}),
whole AS (SELECT row_number() OVER () AS r, doc_id, {form("coalesce(text, '')")} AS t FROM documents),
digested AS (SELECT r, doc_id, sha256(trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g'), ' ')) AS digest FROM whole),
lines AS (SELECT r, trim(unnest(string_split(t, chr(10))), ' ') AS line FROM whole),
notices AS (SELECT l.r, k.licence FROM (SELECT r, sha256(line) AS digest FROM lines WHERE line <> '') l JOIN known k USING (digest)),
listed AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n FROM notices GROUP BY r)
SELECT d.doc_id, d.digest, k.licence, coalesce(n.notices, '') AS notices, coalesce(n.n, 0) AS n_notices
FROM digested d LEFT JOIN known k USING (digest) LEFT JOIN listed n USING (r)"""
