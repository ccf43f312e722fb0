"""License scans: canonical digests of entire texts, and of entire lines, joined to known ones."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantstate.llm.common import at, blank_if_null, let, numbered, stage
from plantstate.llm.license_digests import DIGESTS

#: Spellings that count as equal, as (from, to) inside a text whose words have a space on
#: each side. Each changes single words only, so that lines can be made canonical apart from each other.
SPELLINGS = (
    (" licence", " license"),
    (" organis", " organiz"),
    (" redistribute ", " redistribution "),
    (" redistributing ", " redistribution "),
    (" sublicens", " sub  licens"),
    (" noninfringement ", " non  infringement "),
    (" merchantibility ", " merchantability "),
    (" owner ", " holder "),
    (" gpl ", " gnu  general  public  license "),
    (" whilst ", " while "),
    (" https ", " http "),
)
#: A line that holds a copyright notice, and the words one of which such a line has.
NOTICE = r"(^|\n)[^a-z0-9\n]*(?:copyright\b[^\n]*(?:[0-9]{4}|\(c\)|©)|\(c\)|©)[^\n]*"
NOTICE_WORDS = ("copyright", "(c)", "©")

#: Creative Commons licences in full words, and where their versions hold.
COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def _commons() -> dict[str, str]:
    """Notices of one line of the Creative Commons licences: name and spelling, text."""
    out = {}
    for kind, words in COMMONS.items():
        for version, area in VERSIONS.items():
            name = f"CC {kind} {version} notice"
            split = words.replace("NonC", "Non-C").replace("ShareA", "Share-A")
            for lead, mark in (("Licensed under", ""), ("This work is licensed under", ", of a work"), ("Released under", ", released")):
                out[f"{name}{mark}"] = f"{lead} CC {kind} {version}."
                long = {"": f"{words} {version} {area}", " and split": f"{split} {version} {area}", " and without area": f"{words} {version}", " and split, without area": f"{split} {version}"}
                for more, form in long.items():
                    out[f"{name}{mark}, in full{more}"] = f"{lead} a Creative Commons {form} License."
    return out


#: Known texts. The first are notices of one line, the rest whole licences.
KNOWN = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    **_commons(),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003\n\n"
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative "
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\n"
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, "
        "must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative "
        "works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE "
        "FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}


def _spelled(plain: str, to: str) -> Callable[[Column], Column]:
    return lambda t: F.when(F.contains(t, F.lit(plain)), F.replace(t, F.lit(plain), F.lit(to))).otherwise(t)


def canonical_lines(text: Column) -> Column:
    """The lines of a text in lower case, without copyright lines and lines without a letter or digit,
    with equal spellings, words apart by one space. Texts that lack a spelling's or a notice's letters skip its replacement."""

    def unnoticed(t: Column) -> Column:
        has = F.contains(t, F.lit(NOTICE_WORDS[0])) | F.contains(t, F.lit(NOTICE_WORDS[1])) | F.contains(t, F.lit(NOTICE_WORDS[2]))
        return F.when(has, F.regexp_replace(t, NOTICE, "$1")).otherwise(t)

    # Two spaces between words, so that neighbours don't share the space that a spelling takes.
    words = F.regexp_replace(let(F.lower(blank_if_null(text)), unnoticed), r"[^\p{L}\p{N}\n]+", "  ")
    t = F.concat(F.lit(" "), F.replace(words, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for plain, to in SPELLINGS:
        t = let(t, _spelled(plain, to))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.replace(x, F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    """The canonical lines as one text: how a text is broken into lines doesn't count."""
    return F.array_join(canonical_lines(text), " ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def digests(known: DataFrame) -> DataFrame:
    """name, digest of known texts (columns name, text); of names with one digest the first by order stays."""
    return known.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("name").alias("name"))


def known_texts(df: DataFrame, known: Mapping[str, str] = KNOWN) -> DataFrame:
    return df.sparkSession.createDataFrame(sorted(known.items()), "name string, text string")


def known_digests(df: DataFrame) -> DataFrame:
    """digest, name of the licences that are shipped as digests; none of them is a text of KNOWN."""
    return df.sparkSession.createDataFrame(sorted(DIGESTS.items()), "digest string, name string")


def scanned(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, digest, license (of the entire text, else null) and notices (names of lines that are known texts, sorted, each once).

    Null and empty texts, and texts of punctuation only, have the digest of an empty text
    and no license. Repeated rows give repeated rows. The join's other side is the table of
    known digests; whether it is broadcast is Spark's choice by its size. Texts of any length
    are read whole, and an empty table gives no rows. A text that two names are known for has
    the smaller name."""
    d = numbered(docs)
    found = digests(known_texts(docs)).unionByName(known_digests(docs)) if known is None else digests(known)
    found = found.select(F.unhex("digest").alias("k_digest"), "name")
    d = d.select(F.monotonically_increasing_id().alias("row"), d[at(docs, id_col)].alias("key"), canonical_lines(d[at(docs, text_col)]).alias("lines"))
    d = d.select("row", "key", F.unhex(F.sha2(F.array_join("lines", " "), 256)).alias("digest"), F.array_distinct(F.transform("lines", lambda x: F.unhex(F.sha2(x, 256)))).alias("lines"))
    d = stage(d, "digests")
    # Inner joins first: only matches are gathered by row.
    one_line = d.select("row", F.explode("lines").alias("k_digest")).join(found, "k_digest").groupBy("row").agg(F.sort_array(F.collect_set("name")).alias("notices"))
    entire = d.select("row", "key", "digest").join(found, F.col("digest") == F.col("k_digest"), "left").drop("k_digest")
    none = F.array().cast("array<string>")
    return entire.join(one_line, "row", "left").select("key", F.lower(F.hex("digest")).alias("digest"), F.col("name").alias("license"), F.coalesce("notices", none).alias("notices"))
