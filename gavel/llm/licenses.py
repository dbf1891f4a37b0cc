"""License scans by canonical digests, in DataFrame functions only.

A text is made canonical: lower case; lines that state a copyright dropped;
everything but letters and digits a space; equivalent spellings made one. Its
SHA-256 is looked up among those of known licences by a hash join. Each
document is looked up as one text, and so is each of its lines, as notices
stand on lines of their own, and each block of lines that begins as an entire
licence text does and is as long: a wrapped licence above code or prose. The
list of known licences is fixed and short, so its side of the join is
broadcast; a caller's own list is joined as Spark sees fit, and looked up by
text and line, as digests don't tell how a text begins.

Defined results: null texts match nothing, and neither do texts that have no
letter or digit; a document gives one row for each (licence, scope) with the
number of matching texts; repeated rows of a doc_id count together; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm.license_forms import bodies, titles

# Equivalent spellings, from public licence matching guidelines; the first is made the second.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorise", "authorize"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("initialise", "initialize"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# Names under which notices cite a licence.
NAMES = {
    "0BSD": ["Zero-Clause BSD License", "0BSD License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "BSD-3-Clause"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0"],
    "ISC": ["ISC License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL-3.0"],
    "MIT": ["MIT License", "MIT"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
}
# How a notice begins.
OPENINGS = ["", "Licensed under", "Released under", "Distributed under", "Published under", "Available under", "This work is licensed under", "This work is released under", "This file is licensed under", "This software is licensed under", "This project is licensed under", "This document is licensed under", "SPDX-License-Identifier:"]

# Texts of short licences, without their copyright lines.
TEXTS = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

# A line that states a copyright, after its line break.
_COPYRIGHT = r"\n[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|:|[0-9<\[]|by )|\(c\)[ \t]*[0-9<\[]|©|all rights reserved)[^\n]*"
_OTHER = r"[^\p{L}\p{N}\n]+"


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of the fixed list: full texts, and notices of every opening and name."""
    found = [(k, t) for k, t in TEXTS.items()]
    for licence, names in NAMES.items():
        for name in names:
            for opening in OPENINGS:
                if opening or len(name) > 5:
                    found += [(licence, f"{opening} {the}{name}") for the in (("the ", "") if opening else ("",))]
    return found


def canonical(text: Column) -> Column:
    """Canonical text; line breaks stay, with spaces beside them."""
    out = F.regexp_replace(F.concat(F.lit("\n"), F.lower(text)), _COPYRIGHT, "\n")
    out = F.regexp_replace(out, _OTHER, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def one_line(text: Column) -> Column:
    """Canonical text on one line; spellings of two words may have stood across a line break."""
    out = F.trim(F.regexp_replace(text, "[ \n]+", " "))
    for a, b in SPELLINGS:
        if " " in a:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


#: Words by which the beginning of an entire text is found.
HEAD_WORDS = 5


def _canonical_lines(spark: SparkSession, texts: list[str]) -> list[str]:
    quoted = ", ".join("({}, '{}')".format(i, t.replace("\\", "\\\\").replace("'", "\\'")) for i, t in enumerate(texts))
    rows = spark.sql(f"SELECT * FROM VALUES {quoted} AS texts(i, text)").select("i", one_line(canonical(F.col("text"))).alias("t")).collect()
    return [r.t for r in sorted(rows, key=lambda r: r.i)]


@cache
def _entire(spark: SparkSession) -> list[tuple[str, str]]:
    """(licence, canonical line) of entire texts without titles."""
    made = bodies(TEXTS)
    return sorted(set(zip((k for k, _ in made), _canonical_lines(spark, [t for _, t in made]), strict=True)))


@cache
def _known_digests(spark: SparkSession) -> list[tuple[str, str]]:
    """(licence, digest) of entire texts, of those below a title and of notices."""
    entire, notices = _entire(spark), known_texts()
    under = [(k, name) for k, names in titles(NAMES).items() for name in names]
    lines = _canonical_lines(spark, [t for _, t in notices] + [t for _, t in under])
    found = entire + list(zip((k for k, _ in notices), lines, strict=False))
    found += [(k, f"{title} {t}") for (k, _), title in zip(under, lines[len(notices) :], strict=True) for j, t in entire if j == k]
    return sorted({(k, hashlib.sha256(t.encode()).hexdigest()) for k, t in found})


def block_forms(spark: SparkSession) -> list[tuple[str, int, tuple[int, ...]]]:
    """(beginning, length) of entire texts, each with the lengths of the licence's texts that it begins with: where one of them ends a line, it stands for the longer one, so that a place counts once."""
    texts = _entire(spark)
    return sorted({(" ".join(x.split(" ")[:HEAD_WORDS]), len(x), tuple(sorted(len(y) for j, y in texts if j == k and x.startswith(f"{y} ")))) for k, x in texts})


def _blocks(spark: SparkSession, t: Column) -> Column:
    """Array of the blocks of lines in canonical text that begin and end as an entire licence text may."""
    forms = block_forms(spark)
    longest = max(n for _, n, _ in forms) + 2
    begins = f"(?:{'|'.join(sorted({x.replace(' ', '[ \n]+') for x, _, _ in forms}))})(?![^ \n])"
    known_forms = F.array(*(F.struct(F.lit(x).alias("head"), F.lit(n).alias("n"), F.array(*map(F.lit, less)).cast("array<int>").alias("less")) for x, n, less in forms))
    flat = F.regexp_replace(t, " *\n[ \n]*", "\n")
    for a, b in SPELLINGS:
        if " " in a:
            flat = F.replace(F.replace(flat, F.lit(a.replace(" ", "\n")), F.lit(b)), F.lit(a), F.lit(b))

    def block(parts: Column, i: Column) -> Column:
        rest = F.rtrim(F.substring(F.array_join(F.slice(parts, i, F.size(parts)), "\n"), 1, longest))
        first = lambda n: F.translate(rest.substr(F.lit(1), n), "\n", " ")
        ends = lambda n: (F.length(rest) >= n) & rest.substr(n + F.lit(1), F.lit(1)).isin("\n", "")
        fit = F.filter(known_forms, lambda x: ends(x["n"]) & (first(F.length(x["head"])) == x["head"]) & ~F.exists(x["less"], ends))
        return F.transform(fit, lambda x: first(x["n"]))

    found = F.transform(F.array(F.split(flat, f"\n(?={begins})")), lambda p: F.flatten(F.transform(F.slice(F.sequence(F.lit(1), F.size(p)), 2, F.size(p)), lambda i: block(p, i))))[0]
    return F.when(t.rlike(f"\n *{begins}"), found).otherwise(F.array().cast("array<string>"))


def digests(docs: DataFrame, blocks: bool = True) -> DataFrame:
    """(doc_id, scope, digest) of each document's whole text, of each of its lines and of what may be an entire licence in it; empty texts have none."""
    made = docs.where("text is not null").select("doc_id", canonical(F.col("text")).alias("t"))
    unit = lambda scope, text: F.struct(F.lit(scope).alias("scope"), text.alias("text"))
    parts = [F.array(unit("text", one_line(F.col("t")))), F.transform(F.split("t", "\n"), lambda x: unit("line", F.trim(x)))]
    if blocks:
        parts.append(F.transform(_blocks(docs.sparkSession, F.col("t")), lambda x: unit("block", x)))
    units = made.select("doc_id", F.explode(F.concat(*parts)).alias("u")).where("u.text <> ''")
    return units.select("doc_id", "u.scope", F.sha2("u.text", 256).alias("digest"))


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, digest) of known licences."""
    if texts:
        lines = _canonical_lines(spark, [t for _, t in texts])
        rows = sorted({(k, hashlib.sha256(t.encode()).hexdigest()) for (k, _), t in zip(texts, lines, strict=True)})
    else:
        rows = _known_digests(spark)
    quoted = ", ".join("('{}', '{}')".format(k.replace("\\", "\\\\").replace("'", "\\'"), d) for k, d in rows)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS known(license_id, digest)")


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """(doc_id, license_id, scope, n): documents whose whole text, or n of whose lines or blocks, are a known licence."""
    table = F.broadcast(known(docs.sparkSession)) if licenses is None else licenses
    return digests(docs, licenses is None).join(table, "digest").groupBy("doc_id", "license_id", "scope").agg(F.count("*").alias("n"))


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(regexp_replace(concat(chr(10), lower({text})), '{_COPYRIGHT}', chr(10), 'g'), '{_OTHER}', ' ', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _sql_spelled(out: str) -> str:
    for a, b in SPELLINGS:
        if " " in a:
            out = f"replace({out}, '{a}', '{b}')"
    return out


def _sql_one_line(text: str) -> str:
    return _sql_spelled(f"trim(regexp_replace({_sql_canonical(text)}, '[ \\n]+', ' ', 'g'), ' ')")


def _sql_values(texts: list[tuple[str, str]]) -> str:
    return ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in texts)


def scan_sql() -> str:
    """scan() of `documents` with the fixed list, for DuckDB: whole texts, lines and blocks of lines."""
    entire, notices = sorted(set(bodies(TEXTS))), known_texts()
    names = [(k, t) for k, found in titles(NAMES).items() for t in found]
    flat = "regexp_replace(t, ' *\\n[ \\n]*', chr(10), 'g')"
    for a, b in SPELLINGS:
        if " " in a:
            flat = f"replace(replace({flat}, '{a.replace(' ', chr(10))}', '{b}'), '{a}', '{b}')"
    return f"""
    WITH entire AS (SELECT DISTINCT license_id, {_sql_one_line("text")} AS t FROM (VALUES {_sql_values(entire)}) AS v(license_id, text)),
    notices AS (SELECT DISTINCT license_id, {_sql_one_line("text")} AS t FROM (VALUES {_sql_values(notices)}) AS v(license_id, text)),
    names AS (SELECT DISTINCT license_id, {_sql_one_line("text")} AS t FROM (VALUES {_sql_values(names)}) AS v(license_id, text)),
    known AS (SELECT * FROM entire UNION SELECT * FROM notices UNION SELECT e.license_id, concat(n.t, ' ', e.t) FROM names n JOIN entire e USING (license_id)),
    made AS (SELECT row_number() OVER () AS r, doc_id, {_sql_canonical("text")} AS t FROM documents WHERE text IS NOT NULL),
    units AS (SELECT doc_id, 'text' AS scope, {_sql_spelled("trim(regexp_replace(t, '[ \\n]+', ' ', 'g'), ' ')")} AS t FROM made
              UNION ALL SELECT doc_id, 'line' AS scope, trim(unnest(string_split(t, chr(10))), ' ') AS t FROM made),
    parted AS (SELECT r, doc_id, string_split({flat}, chr(10)) AS l, heads FROM made, (SELECT list(DISTINCT split_part(t, ' ', 1)) AS heads FROM entire)),
    begins AS (SELECT r, doc_id, l, unnest(list_filter(range(1, len(l) + 1), lambda i: list_contains(heads, split_part(l[i], ' ', 1)))) AS i FROM parted),
    rests AS (SELECT r, doc_id, i, split_part(l[i], ' ', 1) AS head, rtrim(array_to_string(l[i:], chr(10)), ' ') AS rest FROM begins),
    found AS (SELECT r, doc_id, i, license_id, e.t FROM rests JOIN entire e ON head = split_part(e.t, ' ', 1) AND replace(substr(rest, 1, length(e.t)), chr(10), ' ') = e.t AND substr(rest, length(e.t) + 1, 1) IN ('', chr(10))),
    blocks AS (SELECT * FROM found x WHERE NOT EXISTS (SELECT 1 FROM found y WHERE y.r = x.r AND y.i = x.i AND y.license_id = x.license_id AND starts_with(x.t, concat(y.t, ' '))))
    SELECT u.doc_id, k.license_id, u.scope, CAST(count(*) AS BIGINT) AS n FROM units u JOIN known k ON u.t = k.t AND u.t <> '' GROUP BY ALL
    UNION ALL SELECT doc_id, license_id, 'block' AS scope, CAST(count(*) AS BIGINT) AS n FROM blocks GROUP BY ALL"""
