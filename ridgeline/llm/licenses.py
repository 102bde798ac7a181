"""License scans by canonical digests.

A text is brought to a canonical form and its digest joined to the digests of
known licence texts and notices. The form lower-cases A-Z, drops copyright
lines, writes equivalent spellings one way, and turns every run of marks and
white space into one space. A whole document is looked up as one text, and so
is each of its lines, since short notices stand alone on a line.

The bare form serves texts as they are published: it also drops title lines at
the head of a paragraph, and copyright lines behind comment marks, while lines
of running text that happen to begin with "copyright" or "(c)" stay. A whole
document that its first digest does not know is looked up again by its bare
form. In longer documents, a paragraph that opens a known text is followed for
as many words as that text has, whatever the wrapping and the paragraphs.

The catalogue is ``KNOWN``, the short notices, and the files of
``license_texts``, complete texts and standard headers named by their licence.

Cases: null and empty texts, and texts that are nothing but copyright lines,
match nothing and have a null digest; very long texts are digested whole;
repeated rows get equal answers; ids may be null or repeat; a known text given
twice counts once for each licence; an empty table gives no rows; further
columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import documents, only
from ridgeline.llm.registry import query

# Public licence texts and notices, by their SPDX-style names.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
            "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
            "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
            "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
            "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
            "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
            "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
            "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
            "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
            "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, Version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
)

# Fixed values: (pattern over canonical words, one spelling for it), in the order of application.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("share alike", "sharealike"), ("neighbouring", "neighboring"),
    ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("per cent", "percent"),
    ("https", "http"), ("version ", "v "), ("copyright owner", "copyright holder"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that names the holder of a copyright.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
#: Runs of marks and white space, line ends excepted.
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAPS = r"[ \n]+"
#: A copyright line of the bare form, which may stand behind comment marks and does not go on a sentence.
BARE_COPYRIGHT_LINE = (
    r"(^|\n)[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*(?:©|\(c\)(?=[^\n]*[0-9]{4})|copyright(?!\W+(?:notices?|holders?|owners?|ownership|laws?|and|"
    r"interest|license|permission|patent|statement|treaty|resulting|or|on|also|like|those|are|if|in|is|more|of|doctrines|including|line|"
    r"disclaimer|then|the (?:software|library|program))\b))[^\n]*")
#: Title lines of a paragraph's head, after marks have become spaces.
TITLES = (
    r"(?:the )?mit license(?: mit)?", r"(?:the )?isc license(?: isc)?", r"(?:the )?(?:(?:new|modified|simplified|revised|original) )?bsd(?: [0-9] clause)?(?: license)?",
    r"(?:the )?(?:bsd )?[23] clause(?: bsd)? license", r"bsd [23] clause (?:new or revised |simplified )?license", r"(?:bsd zero clause license|zero clause bsd|0bsd)",
    r"(?:the )?unlicense", r"apache license(?: version 2 0)?(?: january 2004)?", r"version 2 0 january 2004", r"https? www apache org licenses",
    r"gnu (?:lesser |library |affero )?general public license", r"gnu free documentation license", r"version [0-9][0-9. ]* ?[0-9]* [a-z]+ [0-9]{4}",
    r"mozilla public license(?: version)?(?: [12] [01])?", r"version [0-9] [0-9]", r"creative commons legal code", r"cc0 1 0 universal",
    r"(?:creative commons )?attribution sharealike 4 0 international(?: public license)?", r"sil open font license(?: version 1 1 26 february 2007)?",
    r"unicode license v3", r"spdx license identifier [^\n]*", r"all rights reserved", r"licen[cs]e")
TITLE_LINES = r"(^[ \n]*|\n *\n[ \n]*)(?:(?:" + "|".join(TITLES) + r") *(?:\n[ \n]*|(?![\s\S])))+"
PARAGRAPH = r"\n *\n[ \n]*"
#: Every known text of the catalogue holds one of these; nothing else is searched for paragraphs.
CUES = r"licen[cs]e|permission|redistribution|redistribute|public domain|copyright|rights reserved"
TEXTS_END = r"(?m)^\W*END OF TERMS AND CONDITIONS\W*$"


def folded(text: Column) -> Column:
    """Lower case, without copyright lines and marks; line ends stay."""
    c = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINE, "$1")
    return F.regexp_replace(c, MARKS, " ")


def spelled(form: Column) -> Column:
    """One spelling for equivalent ones; null where nothing is left."""
    c = F.trim(form)
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.nullif(c, F.lit(""))


def canonical(text: str) -> str:
    """The same rule on the driver, for the few known texts."""
    c = re.sub(COPYRIGHT_LINE, r"\1", text.translate(str.maketrans(UPPER, LOWER)))
    c = re.sub(GAPS, " ", re.sub(MARKS, " ", c)).strip(" ")
    for old, new in SPELLINGS:
        c = c.replace(old, new)
    return c


def digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def bare(text: str) -> str:
    """The bare form, line ends kept, on the driver."""
    c = re.sub(BARE_COPYRIGHT_LINE, r"\1", text.translate(str.maketrans(UPPER, LOWER)))
    return re.sub(TITLE_LINES, r"\1", re.sub(MARKS, " ", c))


def bare_form(text: Column) -> Column:
    c = F.regexp_replace(F.translate(text, UPPER, LOWER), BARE_COPYRIGHT_LINE, "$1")
    return F.regexp_replace(F.regexp_replace(c, MARKS, " "), TITLE_LINES, "$1")


def paragraphs(form: str) -> list[str]:
    return [c for p in re.split(PARAGRAPH, form) if (c := canonical(p))]


def known_digests(known: tuple[tuple[str, str], ...] = KNOWN) -> dict[str, str]:
    """Digest to licence of the catalogue; the first name in order wins a shared text."""
    rows = sorted(((hashlib.sha256(canonical(text).encode()).hexdigest(), name) for name, text in known), reverse=True)
    return dict(rows)


def published(folder: Path = Path(__file__).parent / "license_texts") -> tuple[tuple[str, str], ...]:
    """(licence, text) of every file NAME.txt or NAME~VARIANT.txt, and of the ways in which such texts are cut and numbered.

    Texts with an appendix also go without it, and short ones also without the numbers of their list.
    """
    out = []
    for path in sorted(folder.glob("*.txt")):
        name, text = path.stem.split("~")[0], path.read_text(encoding="utf-8")
        forms = [text]
        if end := re.search(TEXTS_END, text):
            forms += [text[:end.end()], text[:end.start()]]
        if name.startswith("BSD-"):
            forms.append(re.sub(r"(?m)^(\s*)[0-9]\.", r"\1", text))
        out += [(name, form) for form in forms]
    return tuple(out)


def catalogue(known: tuple[tuple[str, str], ...]) -> tuple[dict[str, str], dict[str, list[int]]]:
    """Digest to licence of all forms of the known texts, and digest of an opening paragraph to the numbers of words that may follow from it."""
    sha = lambda c: hashlib.sha256(c.encode()).hexdigest()
    names: dict[str, str] = {}
    openings: dict[str, set[int]] = {}
    for name, text in known:
        parts = paragraphs(bare(text))
        if not parts:                   # a notice that is nothing but a title is looked up by lines only
            names.setdefault(sha(canonical(text)), name)
            continue
        whole = " ".join(parts)
        if not re.search(CUES, whole):
            raise ValueError(f"no cue in a text of {name}")
        for form in (canonical(text), canonical(bare(text)), whole):
            names.setdefault(sha(form), name)
        for opening in (parts[0], whole):
            openings.setdefault(sha(opening), set()).add(whole.count(" ") + 1)
    return names | known_digests(tuple(x for x in known if x in KNOWN)), {k: sorted(v) for k, v in openings.items()}


def scan_licenses(docs: DataFrame, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, digest, license, notices, n_notice_lines).

    ``license`` is that of the whole text, ``notices`` the sorted distinct names
    of the licences whose notice or text is one of its lines, or runs on from
    one of its paragraphs. ``n_notice_lines`` counts such lines, and one for
    every text that runs over several lines. Whole texts meet the catalogue in a
    hash join on their digests; it is a table of some hundred rows, a list fixed
    in the package, so it is the side that is broadcast and no document moves.
    Lines and paragraphs are looked up where they are.
    """
    names, openings = catalogue(KNOWN + published() if known is None else known)
    known_texts = docs.sparkSession.createDataFrame(list(names.items()), "known string, name string")
    literal = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string, string>")
    name_of = lambda d: F.when(d.isin(list(names)), F.element_at(literal, d))
    lengths_of = F.create_map(*[x for k, v in openings.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if openings else F.create_map().cast("map<string, array<int>>")
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.explode(F.array(F.struct(folded(text).alias("form"), text.alias("text")))).alias("t"))
    d = d.select("doc_id", "t.form", F.when(F.col("t.form").rlike(CUES) | F.col("t.text").rlike("(?i)copyright"), bare_form(F.col("t.text"))).alias("bare"))
    d = d.withColumns({"digest": digest(spelled(F.regexp_replace("form", GAPS, " "))), "bare_digest": digest(spelled(F.regexp_replace("bare", GAPS, " ")))})
    for of, found in (("digest", "license_as_is"), ("bare_digest", "license_bare")):
        d = d.join(F.broadcast(known_texts.select(F.col("known").alias(of), F.col("name").alias(found))), of, "left")
    d = d.withColumn("license", F.coalesce("license_as_is", "license_bare"))
    lines = F.filter(F.transform(F.split("form", "\n"), lambda line: name_of(digest(spelled(line)))), lambda name: name.isNotNull())
    parts = F.filter(F.transform(F.split("bare", PARAGRAPH), lambda p: F.struct(
        F.trim(p, F.lit(" \n")).contains("\n").alias("wrapped"), spelled(F.regexp_replace(p, GAPS, " ")).alias("words"))), lambda p: p["words"].isNotNull())
    d = d.withColumn("lines", lines).withColumn("parts", parts)
    opened = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("at"), p["wrapped"].alias("wrapped"), digest(p["words"]).alias("opening"),
                                                                 F.size(F.split(p["words"], " ")).alias("size"))),
                      lambda p: p["opening"].isin(list(openings)))

    def runs(p: Column) -> Column:
        """Names of the texts that run on from the paragraph; one that is a single line is found among the lines."""
        lengths = F.filter(F.element_at(lengths_of, p["opening"]), lambda n: p["wrapped"] | (n != p["size"]))
        rest = lambda n: F.concat_ws(" ", F.slice(F.col("parts")["words"], p["at"] + 1, n))
        return F.transform(lengths, lambda n: name_of(digest(F.call_function("substring_index", rest(n), F.lit(" "), n))))

    over = F.filter(F.flatten(F.transform(opened, runs)), lambda name: name.isNotNull())
    d = d.withColumn("hits", F.concat("lines", F.coalesce(over, F.array().cast("array<string>"))))
    return d.select("doc_id", "digest", "license", F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"),
                    F.size("hits").cast("bigint").alias("n_notice_lines"))


def _sql() -> str:
    quoted = lambda x: x.replace("'", "''")

    def spell(c: str) -> str:
        c = f"trim({c}, ' ')"
        for old, new in SPELLINGS:
            c = f"replace({c}, '{old}', '{new}')"
        return f"nullif({c}, '')"

    rows = ", ".join(f"('{k}', '{quoted(v)}')" for k, v in sorted(known_digests().items()))
    return f"""
with known(digest, license) as (values {rows}),
folded as (
  select doc_id, row_number() over () as rid,
    regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', '\\1', 'g'), '{MARKS}', ' ', 'g') as form
  from documents),
lines as (select rid, unnest(string_split(form, chr(10))) as line from folded),
hits as (
  select rid, string_agg(distinct license, ',' order by license) as notices, count(*) as n
  from lines join known on known.digest = sha256({spell('line')}) group by rid)
select doc_id, sha256({spell(f"regexp_replace(form, '{GAPS}', ' ', 'g')")}) as digest, license, coalesce(notices, '') as notices,
  coalesce(n, 0) as n_notice_lines
from folded left join hits using (rid) left join known on known.digest = sha256({spell(f"regexp_replace(form, '{GAPS}', ' ', 'g')")})"""


@query("op5_license_scan", _sql())
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, as a whole and line by line."""
    return scan_licenses(only(documents(spark, sf_dir), doc_id="doc_id", text="text"))
