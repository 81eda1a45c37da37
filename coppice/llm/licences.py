"""Licence scans by canonical digest lookup.

Texts are brought to a canonical form: lower case, runs of anything but letters and digits one space, copyright lines
dropped, equivalent spellings made one. The digest of the whole canonical text, and that of each of its lines, is
looked up among the digests of known licences and licence notices. All of it is built-in functions over one scan; the
known texts are constants of this module and the digests of longer ones a data file beside it, so the side that is
broadcast has a fixed size, and no row is shuffled.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings (left to right), words of the canonical form.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("while", "whilst"),
    ("wilful", "willful"),
)

#: A canonical line that only says whose the copyright is.
COPYRIGHT = "^(copyright (c )?|c )([0-9]{4}|year|yyyy)( .*)?$|^all rights reserved$"

# Parts of licence texts, and the known texts.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_AS_IS}"""
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

#: Known licences and notices: (identifier, text). Copyright lines are not part of them.
KNOWN = (
    ("MIT", f"MIT License\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT}"),
    ("MIT", _MIT),
    ("ISC", f"ISC License\n{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_TAIL}"),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_TAIL}"),
    ("0BSD", f"{_GRANT}.\n{_ISC_TAIL}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_HEAD}\n{_BSD_NAME}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_NAME}\n{_BSD_TAIL}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
)


def _lines(text: Column) -> Column:
    """Canonical lines without copyright lines and empty ones."""
    def line(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("©"), F.lit("(c)")), r"[^\p{L}\p{N}]+", " "))

    return F.filter(F.transform(F.split(text, "\n"), line), lambda x: (x != "") & ~x.rlike(COPYRIGHT))


_ANY = "(^| )(" + "|".join(a for a, _ in EQUIVALENT) + ")( |$)"


def _spelled(x: Column) -> Column:
    """Every word has blanks of its own while spellings are replaced, so that a repeated word is replaced each time."""
    padded = F.concat(F.lit(" "), F.replace(x, F.lit(" "), F.lit("  ")), F.lit(" "))
    spelled = reduce(lambda c, p: F.replace(c, F.lit(f" {p[0].replace(' ', '  ')} "), F.lit(f" {p[1]} ")), EQUIVALENT, padded)
    return F.when(x.rlike(_ANY), F.trim(F.replace(spelled, F.lit("  "), F.lit(" ")))).otherwise(x)


def digests_of(spark: SparkSession, known: tuple[tuple[str, str], ...]) -> dict[str, str]:
    """Digest of the canonical text -> identifier."""
    table = spark.createDataFrame(list(known), "licence string, text string")
    return {r["d"]: r["licence"] for r in table.select("licence", F.md5(_spelled(F.array_join(_lines(F.col("text")), " "))).alias("d")).collect()}


def full_texts() -> dict[str, str]:
    """Digest -> identifier of the licences whose whole texts are too long for constants (licence_digests.tsv)."""
    rows = Path(__file__).with_name("licence_digests.tsv").read_text().splitlines()
    return {d: i for i, d, _ in (r.split("\t") for r in rows)}


def forms(text: str) -> list[str]:
    """A licence's text as it is distributed: all of it, and, if it has an appendix, what comes before that."""
    end = text.find("END OF TERMS AND CONDITIONS")
    return [text] if end < 0 else [text, text[:end], text[:end] + "END OF TERMS AND CONDITIONS"]


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """Adds text_digest, licence, notices, n_notice_lines to docs, replacing columns of these names.

    text_digest: MD5 of the canonical text; licence: that whose known text equals the whole text, else null; notices:
    the known ones that a line equals (full texts included), sorted and comma-joined ('' if none); n_notice_lines: how many lines do. Null
    text is as the empty text, which is no licence; repeated rows are each reported; no rows give none. A digest that
    two known texts share names the last of them in KNOWN; those of the data file give way to KNOWN.
    """
    spark = docs.sparkSession
    digests = full_texts() | digests_of(spark, known)
    by_digest = F.create_map(*(F.lit(x) for pair in sorted(digests.items()) for x in pair))
    kept = docs.drop("text_digest", "licence", "notices", "n_notice_lines", "_lines", "_found")
    lines = kept.withColumn("_lines", _lines(F.coalesce(F.col("text"), F.lit(""))))
    known_rows = spark.createDataFrame(sorted(digests.items()), "text_digest string, licence string")
    found = F.filter(F.transform("_lines", lambda x: F.try_element_at(by_digest, F.md5(_spelled(x)))), lambda x: x.isNotNull())
    digested = lines.withColumns({"text_digest": F.md5(_spelled(F.array_join("_lines", " "))), "_found": found})
    joined = digested.join(F.broadcast(known_rows), "text_digest", "left")
    return joined.select(
        *kept.columns, "text_digest", "licence", F.array_join(F.array_sort(F.array_distinct("_found")), ",").alias("notices"),
        F.size("_found").cast("long").alias("n_notice_lines"),
    )


def sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The scan of ``documents`` as SQL: doc_id and the columns added."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def spelled(x: str) -> str:
        words = f"list_transform(string_split({x}, ' '), lambda w: ' ' || w || ' ')"
        return "trim(replace(" + reduce(lambda c, p: f"replace({c}, ' {p[0].replace(' ', '  ')} ', ' {p[1]} ')", EQUIVALENT, f"array_to_string({words}, '')") + ", '  ', ' '))"

    lines = (
        f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(replace(lower(x), '©', '(c)'), "
        rf"'[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_matches(x, '{COPYRIGHT}'))"
    )
    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in known)
    return f"""
WITH known_text(licence, text) AS (VALUES {values}),
known AS (SELECT DISTINCT md5({spelled("array_to_string(l, ' ')")}) AS d, licence FROM (SELECT licence, {lines} AS l FROM known_text)),
doc AS (SELECT doc_id, row_number() OVER () AS r, {lines} AS l FROM documents),
line AS (SELECT r, licence FROM (SELECT r, md5({spelled("x")}) AS d FROM (SELECT r, unnest(l) AS x FROM doc)) JOIN known USING (d)),
notice AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n FROM line GROUP BY r),
whole AS (SELECT doc_id, r, md5({spelled("array_to_string(l, ' ')")}) AS text_digest FROM doc)
SELECT doc_id, text_digest, known.licence, coalesce(notices, '') AS notices, CAST(coalesce(n, 0) AS BIGINT) AS n_notice_lines
FROM whole LEFT JOIN known ON known.d = text_digest LEFT JOIN notice USING (r)"""
