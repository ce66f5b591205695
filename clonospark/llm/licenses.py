"""Licence texts found by the digest of their canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licences known by name: (id, equivalent names) (fixed values). Notices are made from them by rule.
NAMES = [
    ("Apache-2.0", ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"]),
    ("MIT", ["mit license", "mit expat license", "mit"]),
    ("GPL-2.0", ["gnu general public license version 2", "gnu general public license version 2 0", "gnu gpl version 2", "gpl version 2", "gplv2"]),
    ("GPL-3.0", ["gnu general public license version 3", "gnu general public license version 3 0", "gnu gpl version 3", "gpl version 3", "gplv3"]),
    ("LGPL-3.0", ["gnu lesser general public license version 3", "gnu lgpl version 3", "lgpl version 3", "lgplv3"]),
    ("AGPL-3.0", ["gnu affero general public license version 3", "gnu agpl version 3", "agpl version 3", "agplv3"]),
    ("MPL-2.0", ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"]),
    ("BSD-2-Clause", ["bsd 2 clause license", "simplified bsd license", "bsd 2 clause"]),
    ("BSD-3-Clause", ["bsd 3 clause license", "new bsd license", "modified bsd license", "bsd 3 clause"]),
    ("ISC", ["isc license", "isc"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0 1 0", "creative commons zero 1 0", "creative commons cc0 1 0 universal"]),
    *[(f"CC-{kind}-4.0", [f"cc {words} 4 0", f"creative commons {long} 4 0 international license", f"creative commons {long} 4 0"]) for kind, words, long in (("BY", "by", "attribution"), ("BY-SA", "by sa", "attribution sharealike"), ("BY-NC", "by nc", "attribution noncommercial"), ("BY-ND", "by nd", "attribution noderivatives"), ("BY-NC-SA", "by nc sa", "attribution noncommercial sharealike"), ("BY-NC-ND", "by nc nd", "attribution noncommercial noderivatives"))],
]

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Whole licence texts (public, fixed values); more are a parameter.
TEXTS = [
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", f"ISC License\n\n{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_AS_IS}"),
    ("0BSD", f"{_GRANT}.\n\n{_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD}\n\n{_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD}\n\n{_BSD_THIRD}\n\n{_BSD_AS_IS}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
]

#: Equivalent spellings, one canonical form each (fixed values).
SPELLINGS = {"licence": "license", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization", "favour": "favor", "noncommercial": "noncommercial", "non commercial": "noncommercial", "no derivatives": "noderivatives", "share alike": "sharealike", "copyright holder": "copyright owner", "and or": "or", "and/or": "or", "https": "http"}

_LEADS = r"^(?:this (?:work|software|program|project|file|document|text|dataset|code) is |the (?:code|text|software) is )?(?:licensed|released|distributed|published|available|made available|provided) under (?:the )?(?:terms of )?(?:the )?"


def canonical(text: Column) -> Column:
    """Case, punctuation, white space, copyright lines, equivalent spellings and lead-in phrases made alike."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, r"(?im)^[ \t/*#;-]*(?:copyright\b(?!\s+(?:holders?|notices?|owners?|and|or|laws?)\b)|\(c\)|©)[^\n]*$|^[ \t]*all rights reserved\.?[ \t]*$", " ")
    t = F.regexp_replace(F.lower(t), r"(?m)^[ \t]*spdx-license-identifier:", "licensed under ")
    t = F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))
    for a, b in SPELLINGS.items():
        if a != b:
            t = F.regexp_replace(t, rf"\b{a.replace('/', ' ')}\b", b)
    t = F.regexp_replace(t, r"\bv(?:ersion)? (?=\d)|\bv(?=\d)", "version ")
    return F.regexp_replace(t, _LEADS, "under ")


def known(spark: SparkSession, texts: list[tuple[str, str]] = TEXTS, names: list[tuple[str, list[str]]] = NAMES) -> DataFrame:
    """(digest, license): whole texts and the notices made from names; SPDX ids count as names."""
    rows = [(i, t) for i, t in texts] + [(i, f"licensed under {n}") for i, ns in names for n in [i, *ns]]
    lit = F.array(*[F.struct(F.lit(i).alias("license"), F.lit(t).alias("t")) for i, t in rows])
    table = spark.range(1).select(F.explode(lit).alias("x")).select("x.license", "x.t")
    return table.select("license", F.sha2(canonical(F.col("t")), 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def known_paragraphs(spark: SparkSession, texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """(license, whole, place, parts, digest): each paragraph of the texts that have several."""
    table = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("license"), F.lit(t).alias("t")) for i, t in texts])).alias("x")).select("x.license", "x.t")
    rows = table.select("license", F.sha2(canonical(F.col("t")), 256).alias("whole"), _paragraphs(F.col("t")).alias("p")).where(F.size("p") > 1)
    return rows.select("license", "whole", F.size("p").alias("parts"), F.posexplode("p").alias("place", "para")).select("license", "whole", "place", "parts", F.sha2("para", 256).alias("digest"))


def _paragraphs(text: Column) -> Column:
    """Canonical paragraphs; those of which nothing is left, as copyright lines, don't count."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), canonical), lambda x: x != "")


def scan(docs: DataFrame, licenses: DataFrame | None = None, key: str = "doc_id", text: str = "text", most: int = 1 << 20, paragraphs: DataFrame | None = None) -> DataFrame:
    """(key, license, scope, n_found) for every text, run of paragraphs or line of text that is, whole, a known licence.

    A document's entire text, each paragraph and each line (with the built-in table only those that could hold a licence, as they
    name one of the words that all its entries share) are brought to canonical form, digested, and
    hash-joined to the digests of the licence table. A known text of several paragraphs (``paragraphs``, as from ``known_paragraphs``; the
    built-in ones without a caller's table) is found inside a longer one where all its paragraphs follow each other: their
    digests are joined one by one and counted by where the text would start. ``scope`` is the largest unit found: document, paragraph or line.

    The tables are broadcast while they have ``most`` rows or fewer; larger ones join by shuffle. A null or
    empty text holds no licence; ``n_found`` counts the units of the scope that has most of them, those of rows with one key and text included; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    own = licenses is None
    table = known(spark) if own else licenses
    parts = known_paragraphs(spark) if own and paragraphs is None else paragraphs
    small = lambda t: F.broadcast(t) if own or t.count() <= most else t
    t = F.coalesce(F.col(text), F.lit(""))
    worth = r"(?i)licen[sc]e|permission|copyright|released under|distributed under|published under|available under|provided under"
    could = docs.select(F.col(key), t.alias("_t"))
    could = could.where(F.col("_t").rlike(worth)) if own else could
    unit = lambda scope: lambda x: F.struct(F.lit(scope).alias("scope"), x.alias("unit"))
    units = F.concat(F.array(unit(0)(F.col("_t"))), F.transform(F.split("_t", r"\n\s*\n"), unit(1)), F.transform(F.split("_t", "\n"), unit(2)))
    exploded = could.select(key, F.explode(units).alias("u")).select(key, "u.scope", "u.unit").where(F.col("unit").rlike(worth if own else r"\S"))
    digests = exploded.select(key, "scope", F.sha2(canonical(F.col("unit")), 256).alias("digest"))
    found = digests.join(small(table), "digest").select(key, "license", "scope")
    if parts is not None:
        para = could.select(key, F.xxhash64("_t").alias("_doc"), F.posexplode(_paragraphs(F.col("_t"))).alias("at", "para"))
        para = para.select(key, "_doc", "at", F.sha2("para", 256).alias("digest")).join(small(parts), "digest")
        runs = para.groupBy(key, "_doc", "license", "whole", "parts", (F.col("at") - F.col("place")).alias("start")).agg(F.countDistinct("place").alias("n"))
        found = found.unionByName(runs.where("n = parts").select(key, "license", F.lit(1).alias("scope")))
    per = found.groupBy(key, "license").agg(F.min("scope").alias("scope"), F.greatest(*[F.count_if(F.col("scope") == i) for i in range(3)]).alias("n_found"))
    return per.select(key, "license", F.element_at(F.array(F.lit("document"), F.lit("paragraph"), F.lit("line")), F.col("scope") + 1).alias("scope"), "n_found")
