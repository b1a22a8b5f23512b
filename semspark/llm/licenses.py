"""Licence scans: canonical digests of entire texts, and of each of their lines, looked up among known licences."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.llm.scratch import cut

#: Tables of known digests with at most so many rows are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 10_000

# Spellings that licence matching holds to be equal, each with the one kept.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("wilful", "willful"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("http", "https"),
]

# Public licence texts and one-line grants.
_NO_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
KNOWN = [
    ("MIT", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
{_NO_WARRANTY_MIT} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
""" + _BSD_END),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]

#: Whole texts in files beside this module, by the name of their licence.
TEXTS = Path(__file__).with_name("license_texts")
#: Title lines of licences, as bare words.
_TITLES = "|".join([
    "(the )?mit license( mit)?", "(the )?expat license", "(the )?isc license( isc)?", "(the )?zlib license( zlib)?",
    "(the )?(bsd )?[23] clause bsd license", "(the )?bsd [23] clause license", "(the )?(simplified|new|modified|revised) bsd license",
    "(the )?apache license( version 2 0( january 2004)?)?", "version 2 0 january 2004", "https www apache org licenses",
    "gnu (lesser |library )?general public license( version [0-9 ]+)?", "version (2|2 1|3) ([0-9]+ )?(june|february) [0-9]{4}",
    "mozilla public license( version)? 2 0", "creative commons legal code", "cc0 1 0 universal",
]).replace("license", "licen[cs]e").replace("https ", "https? ")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A notice starts so and has (c), 'by' or a year after it; a line of prose that starts with the word is text, and so is a
#: list's item (c), unless a year or no more than four words follow.
_OWNED = r"(^|\n)[ \t]*(copyright[ \t]*:?[ \t]*(\(c\)|©|by[ \t]|\[yyyy\]|<year>|[^\n]*\b(19|20)[0-9]{2}\b)|\(c\)[^\n]*\b(19|20)[0-9]{2}\b|©)[^\n]*"
_OWNED_SHORT = r"(^|\n)[ \t]*\(c\)([ \t]+[^ \t\n]+){0,4}[ \t]*(\n|$)"
#: A canonical text without any of these words has nothing to respell.
_SPELT = r"\b(" + "|".join(sorted({old.split()[0] for old, _ in SPELLINGS})) + r")\b"
_NOT_WORD = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def known_texts() -> list[tuple[str, str]]:
    """KNOWN and the whole texts beside this module."""
    return [*KNOWN, *((f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt")))]


def bare_lines(text: Column) -> Column:
    """A text with A-Z lowered, without copyright notices, words set apart by blanks; line ends stay."""
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    out = F.regexp_replace(F.regexp_replace(out, _OWNED, "$1"), _OWNED_SHORT, "$1")
    return F.regexp_replace(out, _NOT_WORD, " ")


def canonical(lines: Column) -> Column:
    """Words of bare lines in the kept spellings, set apart by one blank. Line ends say nothing: 'per' and 'cent' may be on two lines."""
    one = F.trim(F.regexp_replace(lines, "[ \\n]+", " "))
    out = F.concat(F.lit(" "), F.replace(one, F.lit(" "), F.lit("  ")), F.lit(" "))  # each word has blanks of its own
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.when(one.rlike(_SPELT), F.replace(F.trim(out), F.lit("  "), F.lit(" "))).otherwise(one)


def untitled(lines: Column) -> Column:
    """Lines without the licence titles among them, unless nothing else is there."""
    kept = F.array_join(F.filter(F.split(lines, "\n"), lambda x: ~F.trim(F.regexp_replace(x, " +", " ")).rlike(f"^({_TITLES})$")), "\n")
    return F.when(F.trim(F.replace(kept, F.lit("\n"), F.lit(" "))) == "", lines).otherwise(kept)


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license, size) of known texts; of two licences with one digest the smaller name."""
    known = known_texts() if known is None else known
    t = spark.createDataFrame(list(known), "license string, text string").withColumn("canon", canonical(untitled(bare_lines(F.col("text")))))
    return t.where("canon <> ''").groupBy(F.sha2(F.col("canon"), 256).alias("digest")).agg(F.min("license").alias("license"), F.min(F.length("canon")).alias("size"))


def scan(documents: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, digest of the entire canonical text, license that it is but for title lines (else null), n_license_lines, line_licenses.

    line_licenses are the distinct licences whose whole text is one line, ordered and comma-joined; a line's digest is
    looked up only if its length is a known one. Null and empty texts have the digest of no text and no licence; repeated
    rows come back each, an empty table gives none, a very long text is one digest, other columns are never read.
    """
    known = cut(known)
    few = known.count() <= BROADCAST_ROWS
    small = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # lengths of licence texts
    canon = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), bare_lines(F.col(text_col).cast("string")).alias("c"))
    near = F.filter(F.split("c", "\n"), lambda x: (F.length(x) >= (sizes[0] if sizes else 0) // 2) & F.lit(bool(sizes)))  # spellings don't halve a text
    digests = F.transform(F.filter(F.transform(near, canonical), lambda x: F.length(x).isin(sizes)), lambda x: F.sha2(x, 256))
    docs = cut(canon.select("id", "key", F.sha2(canonical(F.col("c")), 256).alias("digest"), F.sha2(canonical(untitled(F.col("c"))), 256).alias("text_digest"), digests.alias("lines")))
    entire = docs.join(small(known.select(F.col("digest").alias("text_digest"), "license")), "text_digest", "left")
    hits = docs.where("size(lines) > 0").select("id", "key", F.explode(F.array_distinct("lines")).alias("digest"), "lines")
    hits = hits.join(small(known.select("digest", F.col("license").alias("line_license"))), "digest")
    times = F.size(F.filter("lines", lambda x: x == F.col("digest")))
    found = hits.select("id", "key", "digest", "line_license", times.alias("n")).distinct().groupBy("id", "key").agg(F.sum("n").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("line_license"))).alias("names"))
    out = entire.alias("e").join(found.alias("f"), F.expr("e.id <=> f.id AND e.key = f.key"), "left")
    return out.select(F.col("e.id").alias(id_col), "digest", "license", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("names", F.lit("")).alias("line_licenses"))


def _sql_bare(text: str) -> str:
    out = f"regexp_replace(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_OWNED}', '\\1', 'g')"
    return f"regexp_replace(regexp_replace({out}, '{_OWNED_SHORT}', '\\1', 'g'), '{_NOT_WORD}', ' ', 'g')"


def _sql_canonical(lines: str) -> str:
    out = f"' ' || replace(trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g')), ' ', '  ') || ' '"
    for old, new in SPELLINGS:
        out = "replace({}, ' {} ', ' {} ')".format(out, old.replace(" ", "  "), new.replace(" ", "  "))
    return f"replace(trim({out}), '  ', ' ')"


def _sql_untitled(lines: str) -> str:
    kept = f"array_to_string(list_filter(string_split({lines}, chr(10)), lambda x: NOT regexp_full_match(trim(regexp_replace(x, ' +', ' ', 'g')), '{_TITLES}')), chr(10))"
    return f"CASE WHEN trim(replace({kept}, chr(10), ' ')) = '' THEN {lines} ELSE {kept} END"


def oracle(table: str = "documents") -> str:
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in known_texts())
    return f"""WITH known AS (SELECT sha256(x) AS digest, min(license) AS license FROM
  (SELECT license, {_sql_canonical('u')} AS x FROM (SELECT license, {_sql_untitled('c')} AS u FROM (SELECT license, {_sql_bare('text')} AS c FROM (VALUES {values}) v(license, text)))) WHERE x <> '' GROUP BY 1),
docs AS (SELECT doc_id, sha256({_sql_canonical('c')}) AS digest, sha256({_sql_canonical('u')}) AS text_digest, list_transform(string_split(c, chr(10)), lambda x: sha256({_sql_canonical('x')})) AS lines
  FROM (SELECT doc_id, c, {_sql_untitled('c')} AS u FROM (SELECT doc_id, {_sql_bare('text')} AS c FROM {table}))),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS names
  FROM (SELECT doc_id, unnest(lines) AS digest FROM docs) l JOIN known k USING (digest) GROUP BY 1)
SELECT d.doc_id, d.digest, k.license, coalesce(f.n, 0) AS n_license_lines, coalesce(f.names, '') AS line_licenses
FROM docs d LEFT JOIN known k ON d.text_digest = k.digest LEFT JOIN found f ON d.doc_id = f.doc_id"""
