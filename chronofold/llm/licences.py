"""Operator 9, licence scan by canonical digest lookup, DataFrame operations only.

A text's canonical form is lower case, without copyright lines, with equivalent
spellings made alike, punctuation and white space reduced to single spaces. The
digest of the whole text's form is looked up among the known licences; each
line's form is looked up too, which finds licence notices inside documents. Full
licence texts (``licence_texts``, one file a licence) are a second table: they are
also sought inside documents, from each line that begins with the first words of
one, by the digest of as many characters as that text has. ``text_digest`` depends
on the text alone, not on what is known. Known tables are the caller's or small
tables of fixed texts, broadcast only if a count shows at most ``MOST_BROADCAST`` entries.

Defined cases: null, empty and copyright-only texts have the empty form, which is
no licence; rows that repeat are reported each, and ids may repeat or be null;
several known names of one form are all reported, joined by " OR " in name order;
an empty known table matches nothing; an empty table gives an empty result; other
columns are never read, whatever their names.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.tables import stored, text_of

MOST_BROADCAST = 100_000

# Spellings that count as equal in licence texts, in the form of words after punctuation is gone.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("acknowledgment", "acknowledgement"),
    ("favor", "favour"), ("per cent", "percent"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"), ("organisation", "organization"),
)

# Public licence texts and one-line notices, by SPDX identifier.
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
)

# Headings that often stand above a text, by SPDX identifier.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "Zlib": ("zlib License", "The zlib License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
}
#: A full text's first words, which its place inside a document is known by; lines that they are read from.
OPENING, OPENING_LINES = 4, 8
#: Distinct lengths of known forms that lines are compared with before they are digested; more are not compared.
MOST_LENGTHS = 10_000

COPYRIGHT_LINE = r"(?im)^[ \t]*(?:[#*/;-]+[ \t]*)?(?:copyright\b|\(c\)|©).*$"


def _form(c: Column) -> Column:
    """Words of a text without its copyright lines, lower case, single spaces, equal spellings alike."""
    c = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return c


def _all_spelt(forms: Column) -> Column:
    """Each form of an array with equivalent spellings made alike; a form without a spelling's letters is only searched for them."""

    def respelt(old: str, new: str):
        return lambda x: F.when(F.contains(x, F.lit(old)), F.regexp_replace(x, rf"\b{old}\b", new)).otherwise(x)

    for old, new in SPELLINGS:
        forms = F.transform(forms, respelt(old, new))
    return forms


def _spelt(c: Column) -> Column:
    return F.element_at(_all_spelt(F.array(c)), 1)


def canonical(c: Column) -> Column:
    return _spelt(_form(F.regexp_replace(c, COPYRIGHT_LINE, "")))


def known_licences(spark: SparkSession, texts: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(digest, chars, opening, licence) of the known texts: distinct canonical forms."""
    rows = texts if isinstance(texts, DataFrame) else spark.createDataFrame(list(KNOWN if texts is None else texts) or [], "licence string, text string")
    forms = rows.select("licence", canonical(F.coalesce("text", F.lit(""))).alias("form")).where("form <> ''").distinct()
    return forms.groupBy(F.sha2("form", 256).alias("digest"), F.char_length("form").alias("chars"), F.substring_index("form", " ", OPENING).alias("opening")).agg(F.array_join(F.array_sort(F.collect_set("licence")), " OR ").alias("licence"))


def full_texts() -> list[tuple[str, str]]:
    """(SPDX identifier, text) of whole licences: each with and without its appendix, its heading, a line of reserved rights, its clauses' numbers, its line ends."""
    found = [(p.stem, p.read_text()) for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))]
    found += [(n, t.split("END OF TERMS AND CONDITIONS")[0] + end) for n, t in found if "END OF TERMS AND CONDITIONS" in t for end in ("", "END OF TERMS AND CONDITIONS")]
    found += [(n, re.sub(r"(?m)^\d\. ", "* ", t)) for n, t in found if n.startswith("BSD-")]
    found += [(n, "All rights reserved.\n" + t) for n, t in found if n.startswith("BSD-")]
    whole = [(n, t) for n, t in KNOWN if "\n" in t]
    # Wrapping decides which of a text's own lines begin with "copyright": paragraphs on one line each, and all on one line.
    found += [(n, "\n\n".join(" ".join(x.split()) for x in re.split(r"\n\s*\n", t))) for n, t in found] + [(n, " ".join(t.split())) for n, t in found]
    return found + [(n, f"{title}\n{t}") for n, t in found + whole for title in TITLES.get(n, ())]


def known_texts(spark: SparkSession) -> DataFrame:
    """``known_licences`` of ``full_texts``."""
    return known_licences(spark, full_texts())


def licence_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: id, text_digest, licence (of the whole text, or null), notices (sorted names found inside), n_notices (lines that are one).

    ``texts``: more known licences, whole texts, which are also found inside documents over several lines.
    """
    known = stored(known.withColumn("inside", F.lit(False)).unionByName(texts.withColumn("inside", F.lit(True))) if texts is not None else known.withColumn("inside", F.lit(False)), "licences")
    names = stored(known.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("licence")), " OR ").alias("licence")), "all-licences")
    lengths = [r[0] for r in known.select("chars").distinct().limit(MOST_LENGTHS + 1).collect()]
    whole_texts = known.where("inside").select("digest", "chars", "opening").distinct()
    n_texts, longest = whole_texts.agg(F.count(F.lit(1)), F.max("chars")).first()
    openings = [r[0] for r in whole_texts.select("opening").distinct().limit(MOST_LENGTHS + 1).collect()]

    bare = F.regexp_replace(text_of(docs, text_col), COPYRIGHT_LINE, "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), F.filter(F.transform(F.split(bare, "\n"), _form), lambda x: x != "").alias("raw"))
    rows = rows.select("row", "id", _all_spelt(F.concat("raw", F.array(F.array_join("raw", " ")))).alias("forms"))
    rows = rows.select("row", "id", F.element_at("forms", -1).alias("whole"), F.slice("forms", 1, F.size("forms") - 1).alias("lines"))
    likely = lambda x: F.char_length(x).isin(lengths) if len(lengths) <= MOST_LENGTHS else F.lit(True)
    begins = lambda i: F.substring_index(_spelt(F.array_join(F.slice("lines", i, OPENING_LINES), " ")), " ", OPENING)
    here = lambda i: begins(i).isin(openings) if len(openings) <= MOST_LENGTHS else F.lit(True)
    places = F.filter(F.sequence(F.lit(1), F.size("lines")), here) if n_texts else F.array().cast("array<int>")
    rest = lambda i: F.substring(_spelt(F.array_join(F.slice("lines", i, F.size("lines")), " ")), 1, (longest or 0) + 1)
    rows = rows.select(
        "row", "id", F.sha2("whole", 256).alias("digest"), F.transform(F.filter("lines", likely), lambda x: F.sha2(x, 256)).alias("line_digests"),
        F.when(F.size("lines") > 1, F.transform(places, rest)).alias("rests"),
    )
    rows = stored(rows, "licence-digests")

    if names.count() <= MOST_BROADCAST:
        names, whole_texts = F.broadcast(names), F.broadcast(whole_texts)
    keyed = names.select(F.col("digest").alias("k"), "licence")
    hits = rows.select("row", F.explode("line_digests").alias("d")).join(keyed, F.col("d") == F.col("k")).select("row", "licence", F.lit(1).alias("n"))
    if n_texts:
        runs = rows.where(F.size("rests") > 0).select("row", F.explode("rests").alias("rest")).withColumn("o", F.substring_index("rest", " ", OPENING))
        runs = runs.join(whole_texts, F.col("o") == F.col("opening"))
        own = (F.sha2(F.expr("substring(rest, 1, chars)"), 256) == F.col("digest")) & F.expr("substring(rest, chars + 1, 1)").isin("", " ")
        hits = hits.unionByName(runs.where(own).select("row", F.col("digest").alias("d")).join(keyed, F.col("d") == F.col("k")).select("row", "licence", F.lit(0).alias("n")))
    hits = stored(hits.groupBy(F.col("row").alias("r")).agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"), F.sum("n").alias("n_notices")), "licence-notices")
    out = rows.join(keyed, F.col("digest") == F.col("k"), "left").join(hits, F.col("row") == F.col("r"), "left")
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("text_digest"), "licence", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
