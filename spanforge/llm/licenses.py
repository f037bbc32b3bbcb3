"""License scans: canonical digests of whole texts, blocks and lines, hash-joined to those of known licences; whole
licence texts also as runs of words anywhere in a document."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Whole texts by licence id, as published; `CORES` says which part of a text is looked for within documents.
TEXTS = Path(__file__).parent / "license_texts"
#: Where the terms of a text begin and what follows them, without title, preamble and appendix.
CORES: dict[str, tuple[str, str | None]] = {
    "Apache-2.0": ("TERMS AND CONDITIONS FOR USE", "END OF TERMS AND CONDITIONS"),
    "CC-BY-SA-4.0": ("Section 1 --", "\n=====\n"),
    "CC0-1.0": ("Statement of Purpose", None),
    "GPL-2.0": ("TERMS AND CONDITIONS FOR COPYING", "END OF TERMS AND CONDITIONS"),
    "GPL-3.0": ("TERMS AND CONDITIONS\n", "END OF TERMS AND CONDITIONS"),
    "LGPL-3.0": ("This version of the GNU Lesser", None),
    "MPL-2.0": ("1. Definitions", "Exhibit A - Source"),
    "Unlicense": ("This is free", "For more information"),
}
#: Fixed value: the third condition of BSD-3-Clause.
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Every core text holds one of these in lower case, so only documents with one are searched for them.
SIGNS = ("warrant", "lesser")
#: Known texts may be broadcast up to this number; the list below is fixed.
MAX_KNOWN = 4096

# Texts of well-known short licences, without their copyright lines.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: Licence ids in their order of bits, and the names that notices give them.
NAMES: dict[str, list[str]] = {
    "0BSD": ["the Zero-Clause BSD License"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the AGPL, version 3"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GPL, version 2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GPL, version 3"],
    "ISC": ["the ISC License"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the LGPL, version 3"],
    "MIT": ["the MIT License", "MIT"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"],
    "Proprietary": [],
    "Unlicense": ["the Unlicense"],
}
#: How notices begin.
LEADS = ["Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This software is licensed under", "This project is licensed under", "This file is licensed under"]
#: Equivalent spellings, as patterns over lower-case text.
SPELLINGS = [("licenc", "licens"), ("(organ|author|recogn)is", "$1iz"), ("favour", "favor"), ("sub[ -]licens", "sublicens"), ("non[ -]commercial", "noncommercial"), ("https?://(www[.])?", ""), ("version ([0-9])", "v$1")]
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"


def known_texts() -> list[tuple[int, str]]:
    """(place of the licence id, whole text) of every known text."""
    place = {x: k for k, x in enumerate(NAMES)}
    texts = [("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("ISC", ISC_GRANT + "\n" + ISC_WARRANTY), ("ISC", "ISC License\n" + ISC_GRANT + "\n" + ISC_WARRANTY), ("0BSD", ZERO_BSD_GRANT + "\n" + ISC_WARRANTY), ("Apache-2.0", APACHE_NOTICE), ("Proprietary", "All rights reserved.")]
    texts += [(i, f"{lead} {name}.") for i, names in NAMES.items() for name in names for lead in LEADS]
    texts += [(i, f"SPDX-License-Identifier: {i}") for i in NAMES]
    return [(place[i], t) for i, t in texts]


def _bsd() -> list[tuple[str, str]]:
    """BSD texts with either word for the holder, and numbers or bullets at the conditions."""
    two, out = (TEXTS / "BSD-2-Clause.txt").read_text(), []
    at = two.index("THIS SOFTWARE IS PROVIDED")
    for i, text in (("BSD-2-Clause", two), ("BSD-3-Clause", two[:at] + BSD_NAMES + "\n\n" + two[at:])):
        for t in (text, text.replace("THE COPYRIGHT HOLDER OR", "THE COPYRIGHT OWNER OR")):
            out += [(i, t), (i, t.replace("1. R", "* R").replace("2. R", "* R").replace("3. N", "* N"))]
    return out


def core_texts() -> list[tuple[str, str]]:
    """(licence id, text) of what is looked for as a run of words anywhere in a document."""
    out = [("MIT", MIT), ("ISC", ISC_GRANT + "\n" + ISC_WARRANTY), ("0BSD", ZERO_BSD_GRANT + "\n" + ISC_WARRANTY), ("Apache-2.0", APACHE_NOTICE), *_bsd()]
    for i, (start, stop) in CORES.items():
        text = (TEXTS / f"{i}.txt").read_text()
        text = text[text.index(start) :]
        if i == "CC-BY-SA-4.0":
            text = text[: text.rindex("=====")].rstrip("=")
        elif stop:
            text = text[: text.index(stop)]
        out.append((i, text))
    return out


def whole_texts() -> list[tuple[int, str]]:
    """(place of the licence id, whole text) of documents that are a licence: the terms alone, under their name, and as published."""
    place, out = {x: k for k, x in enumerate(NAMES)}, []
    for i, text in core_texts():
        if text != APACHE_NOTICE:
            out += [(i, text), *((i, f"{n.removeprefix('the ')}\n\n{rest}{text}") for n in NAMES[i] for rest in ("", "All rights reserved.\n\n")), (i, f"All rights reserved.\n\n{text}")]
    out.append(("MIT", "The MIT License (MIT)\n\n" + MIT))
    for i in CORES:
        text, end = (TEXTS / f"{i}.txt").read_text(), "END OF TERMS AND CONDITIONS"
        out += [(i, text)] + ([(i, text[: text.index(end) + len(end)])] if end in text else [])
    return [(place[i], t) for i, t in out]


def canonical(text: F.Column, notices: bool = False) -> F.Column:
    """Lower case, no copyright lines unless notices is set, one spelling, words of letters and digits; line feeds stay."""
    out = F.lower(text) if notices else F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for pattern, by in SPELLINGS:
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def _flat(part: F.Column) -> F.Column:
    """The words of a canonical text, with one space before each and one at the end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(part, r"[ \n]+", " ")), F.lit(" "))


def with_runs(clean: DataFrame, place: dict[str, int]) -> DataFrame:
    """Adds hits to clean (raw, text): bits of the licences whose terms are a run of words of a document. As a line may
    wrap before the word copyright within the terms, they are also looked for with copyright lines kept."""
    rows = clean.sparkSession.createDataFrame(core_texts(), "id string, text string")
    cores = rows.select("id", _flat(canonical(F.col("text"))).alias("bare"), _flat(canonical(F.col("text"), notices=True)).alias("full")).distinct().collect()
    if not all(any(x in r.bare for x in SIGNS) for r in cores):
        raise ValueError("a core text without a sign")
    own = reduce(lambda a, b: a | b, (F.contains(F.lower("raw"), F.lit(x)) for x in SIGNS))
    bare = clean.withColumn("bare", F.when(own, _flat(F.col("text")))).withColumn("full", F.when(own & F.lower("raw").rlike(COPYRIGHT_LINE), _flat(canonical(F.col("raw"), notices=True))))
    bits = [F.when(F.contains("bare", F.lit(r.bare)) | F.contains("full", F.lit(r.full)), F.lit(1 << place[r.id]).cast("long")).otherwise(F.lit(0).cast("long")) for r in cores]
    hits = F.when(F.col("bare").isNotNull(), reduce(lambda a, b: a.bitwiseOR(b), bits)).otherwise(F.lit(0).cast("long"))
    return bare.withColumn("hits", hits).drop("raw", "bare", "full")


def _digest(part: F.Column) -> F.Column:
    return F.sha2(F.trim(F.regexp_replace(part, r"[ \n]+", " ")).cast("binary"), 256)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, document_license, licenses of each row of docs (doc_id, text).

    document_license: the licence whose known text the whole document is, or null; licenses: ids, comma-separated in
    code point order, of all known texts that the document, a block between empty lines or a line is, and of all
    licences whose whole terms (core_texts) are a run of words of the document, however it is wrapped. Null texts read
    as empty. Each row of docs gives one row, also where its doc_id repeats or is null. Further columns are not read; an
    empty table gives no rows. A row keeps those digests of its units that are among the known ones; only they are joined
    and gathered as bits, so texts don't move, and neither a long document nor a frequent licence makes a large group.
    """
    known = known_texts() + whole_texts()
    if len(known) > MAX_KNOWN:
        raise ValueError("too many known texts to broadcast")
    table = docs.sparkSession.createDataFrame(known, "place int, text string").select("place", _digest(canonical(F.col("text"))).alias("digest")).groupBy("digest").agg(F.min("place").alias("place"))
    clean = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("of"), F.coalesce("text", F.lit("")).alias("raw")).withColumn("text", canonical(F.col("raw")))
    clean = with_runs(clean, {x: k for k, x in enumerate(NAMES)})
    known_digests = [r.digest for r in table.collect()]
    parts = F.array_distinct(F.concat(F.split(F.col("text"), "\n"), F.split(F.col("text"), "\n *\n")))
    met = F.array_intersect(F.transform(F.filter(parts, lambda p: F.trim(p) != ""), _digest), F.array(*map(F.lit, known_digests)))
    rows = stage(clean.select("of.row", "of.doc_id", _digest(F.col("text")).alias("canonical_sha256"), "hits", met.alias("met")))
    units = rows.select("row", F.explode("met").alias("digest")).join(F.broadcast(table), "digest")
    bits = units.groupBy("row").agg(F.expr("bit_or(shiftleft(1L, place))").alias("units"))
    whole = table.select(F.col("digest").alias("canonical_sha256"), F.col("place").alias("whole"))
    by = rows.join(F.broadcast(whole), "canonical_sha256", "left").join(bits, "row", "left")
    by = by.withColumn("bits", F.expr("hits | coalesce(units, 0L) | coalesce(shiftleft(1L, whole), 0L)"))
    names = F.array(*map(F.lit, NAMES))
    named = F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) != 0, F.lit(n)) for k, n in enumerate(NAMES)])
    return by.select("doc_id", "canonical_sha256", F.get(names, F.col("whole")).alias("document_license"), F.array_join(F.array_compact(named), ",").alias("licenses"))


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g')"
    for pattern, by in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


def oracle_sql() -> str:
    digest = lambda x: f"sha256(trim(regexp_replace({x}, '[ \\n]+', ' ', 'g')))"
    values = ", ".join("({}, '{}')".format(k, t.replace("'", "''")) for k, t in known_texts())
    names = ", ".join(f"({k}, '{n}')" for k, n in enumerate(NAMES))
    return f"""
WITH known AS (SELECT {digest(_sql_canonical("t"))} AS digest, min(k) AS place FROM (VALUES {values}) AS v(k, t) GROUP BY 1),
names AS (SELECT * FROM (VALUES {names}) AS n(place, name)),
clean AS (SELECT doc_id, {_sql_canonical("coalesce(text, '')")} AS text FROM documents),
wholes AS (SELECT doc_id, {digest("text")} AS digest FROM clean),
units AS (
  SELECT doc_id, digest FROM wholes
  UNION ALL SELECT doc_id, {digest("p")} FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM clean) WHERE trim(p) <> ''
  UNION ALL SELECT doc_id, {digest("p")} FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n *\\n')) AS p FROM clean) WHERE trim(p) <> ''),
found AS (SELECT DISTINCT u.doc_id, n.name FROM units u JOIN known k ON u.digest = k.digest JOIN names n ON n.place = k.place),
lists AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses FROM found GROUP BY doc_id)
SELECT w.doc_id, w.digest AS canonical_sha256, n.name AS document_license, coalesce(l.licenses, '') AS licenses
FROM wholes w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN names n ON n.place = k.place LEFT JOIN lists l ON l.doc_id = w.doc_id"""
