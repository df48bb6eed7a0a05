"""Operator 5: licence texts, by the digest of their canonical form. DataFrame functions only.

The canonical form of a text is in lower case, without copyright lines, with one spelling for equivalent words and one space
for any run of other characters than letters and digits. Whole texts are matched: their digests are hash-joined to those of known licences.
Null and empty texts, and texts of copyright lines only, have no digest and match nothing. Repeated rows are each reported. If two known texts
have one canonical form, the least id stands for both. Empty tables give no rows; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known texts are broadcast up to so many; beyond, Spark chooses the join.
BROADCAST_ROWS = 100_000

# Equivalent spellings, as (pattern, replacement) on lower-case text; the patterns work in Java and in RE2 alike.
SPELLINGS = [
    (r"\b(sub)?-?licence", r"\1license"),
    (r"\bsub-license", "sublicense"),
    (r"\bnon-?infringement", "noninfringement"),
    (r"\borganisation", "organization"),
    (r"\bfavour", "favor"),
    (r"\bhonour", "honor"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bjudgement", "judgment"),
    (r"\bper cent\b", "percent"),
    (r"\bwhilst\b", "while"),
    (r"\bmerchantibility", "merchantability"),
    (r"\bcopyright owner", "copyright holder"),
    (r"https://", "http://"),
]
# A line that begins with 'copyright holders' or the like is wrapped text of the licence itself, so a sign, a year or a 'by' has to follow.
COPYRIGHT_LINE = r"(?:^|\n)[ \t*#/;-]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4}|by )|\(c\)|©|all rights reserved)[^\n]*"
# Items of lists in licences that begin with the same sign.
ITEM = r"\(c\)(\s+(?:you must retain|the licenses granted in|representations|under patent claims))"
OTHER = r"[^\p{L}\p{N}]+"

# Texts of licences as published.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
LICENSES = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
    ("BSD-2-Clause", f"{_BSD_START}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START}\n\n{_BSD_NAMES}\n\n{_BSD_END}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
]

# Digests of the canonical forms of longer licences as published.
DIGESTS = [
    ("Apache-2.0", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"),  # the file as published
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),  # up to the end of terms
    ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),  # the same without its last line
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),  # with the line of the appendix filled in
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),  # the file as published
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),  # the file as published
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),  # the file as published
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),  # the file as published
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),  # the file as published
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),  # up to the end of terms
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),  # the same without its last line
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),  # the file as published
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),  # up to the end of terms
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),  # the same without its last line
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),  # the file as published
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),  # up to the end of terms
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),  # the same without its last line
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),  # the file as published
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),  # up to the end of terms
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),  # the same without its last line
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),  # the file as published
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),  # up to the end of terms
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),  # the same without its last line
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),  # the file as published
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),  # the file as published
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),  # the file as published
]


def canonical(text: Column) -> Column:
    """The canonical form, null where nothing is left."""
    out = F.regexp_replace(F.lower(text), F.lit(ITEM), F.lit("c$1"))
    out = F.regexp_replace(out, F.lit(COPYRIGHT_LINE), F.lit("\n"))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to.replace("\\1", "$1")))
    out = F.trim(F.regexp_replace(out, F.lit(OTHER), F.lit(" ")))
    return F.nullif(out, F.lit(""))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession) -> DataFrame:
    """license_id, digest of the licences above."""
    texts = spark.createDataFrame(LICENSES, "license_id string, text string").select("license_id", digest(F.col("text")).alias("digest"))
    return texts.unionByName(spark.createDataFrame(DIGESTS, "license_id string, digest string"))


def digests_of(licenses: DataFrame, license_id: str = "license_id", text: str = "text") -> DataFrame:
    """license_id, digest of a table of licence texts, in the form that `scan` takes."""
    return licenses.select(F.col(license_id).alias("license_id"), digest(F.col(text)).alias("digest"))


def scan(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, digest, license_id (null: no licence) for each row of docs. licenses: license_id, digest (default: `known`)."""
    licenses = known(docs.sparkSession) if licenses is None else licenses
    table = licenses.select("digest", F.col("license_id").alias("_license")).where("digest is not null").groupBy("digest").agg(F.min("_license").alias("license_id"))
    if licenses.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    return docs.select(id_col, digest(F.col(text)).alias("digest")).join(table, "digest", "left").select(id_col, "digest", "license_id")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_digest(column: str) -> str:
    out = f"regexp_replace(lower({column}), {_sql_text(ITEM)}, {_sql_text('c' + chr(92) + '1')}, 'g')"
    out = f"regexp_replace({out}, {_sql_text(COPYRIGHT_LINE)}, chr(10), 'g')"
    for pattern, to in SPELLINGS:
        out = f"regexp_replace({out}, {_sql_text(pattern)}, {_sql_text(to)}, 'g')"
    return f"sha256(nullif(trim(regexp_replace({out}, {_sql_text(OTHER)}, ' ', 'g')), ''))"


def oracle_sql() -> str:
    rows = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in LICENSES)
    return (
        f"WITH known(license_id, text) AS (VALUES {rows}), "
        f"longer(license_id, digest) AS (VALUES {', '.join(f'({_sql_text(i)}, {_sql_text(d)})' for i, d in DIGESTS)}), "
        f"each AS (SELECT license_id, {_sql_digest('text')} AS digest FROM known UNION ALL SELECT license_id, digest FROM longer), "
        "k AS (SELECT digest, min(license_id) AS license_id FROM each GROUP BY 1) "
        f"SELECT d.doc_id, d.digest, k.license_id FROM (SELECT doc_id, {_sql_digest('text')} AS digest FROM documents) d LEFT JOIN k ON d.digest = k.digest"
    )
