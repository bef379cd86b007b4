"""License scan: canonical digests of whole texts, paragraphs and lines, joined to the digests of known licences.

A text is folded to lower case; lines that begin with a copyright notice, and lines that hold only the title of one of the
short licences, go; every run of characters
other than letters, digits and line ends becomes a space (so marks of comments go too); and words with an equivalent spelling get one
of them. The SHA-256 of what is left as one line identifies a whole text; those of each paragraph and of each line identify
notices within a text, however they are wrapped. Known licences are put in the same form, and their digests are joined to those of
the texts. Texts themselves are never shuffled.

``KNOWN`` and ``DIGESTS`` name the licences that are known without a table of one's own: short licences and notices by text,
long ones by the digest of their canonical text with and without what follows its terms. AGPL, EPL and Creative Commons texts other than CC0
are not among them; a table ``license, text`` adds any.

Null texts count as empty, and an empty canonical form matches nothing; repeated rows are reported
each; of several licences with one digest all are named; an empty table gives an empty result; other
columns are ignored.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import small, stored

# Spellings that licence matching treats as equal (SPDX matching guidelines).
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("sub licence", "sublicense"), ("organisation", "organization"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("whilst", "while"), ("wilful", "willful"), ("fulfil", "fulfill"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("noncommercial", "non commercial"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("per cent", "percent"), ("http", "https"),
]

# Public licence texts and one-line notices.
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GNU = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{stop} either version {n} of the License, or (at your option) any later version."
KNOWN = [
    ("MIT", _GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("MIT-0", _GRANT + ". " + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>'),
    ("BSL-1.0", 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-2.0-or-later", _GNU.format(what="program", mark=";", kind="", stop=";", n=2)),
    ("GPL-3.0-or-later", _GNU.format(what="program", mark=":", kind="", stop=",", n=3)),
    ("AGPL-3.0-or-later", _GNU.format(what="program", mark=":", kind="Affero ", stop=",", n=3)),
    ("LGPL-2.1-or-later", _GNU.format(what="library", mark=";", kind="Lesser ", stop=";", n="2.1")),
    ("LGPL-3.0-or-later", _GNU.format(what="library", mark=":", kind="Lesser ", stop=",", n=3)),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
# SHA-256 of the canonical forms of public licence texts, as ``known_digests`` makes them; those with "terms" end
# with the terms, without the advice on their use.
DIGESTS = [
    ("Apache-2.0", "8318fc18753641674a0b35f73f00e865e8cceb1ed8b6eb85f62d4a5d5146a5f1"),
    ("Apache-2.0", "6530dac82be99e5bbcc128a6caf5bfdd0451a21fe23ac3df15ed85a1c550c859"),  # terms
    ("Apache-2.0", "2b4a3f34572f63637f58db72bdacad38516a1e1e6788b08931d0a0d5c0be33dd"),  # terms
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-1.0", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),  # terms
    ("GPL-1.0", "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb"),  # terms
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-2.0", "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"),  # terms
    ("GPL-2.0", "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88"),  # terms
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),  # terms
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),  # terms
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),  # terms
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),  # terms
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),  # terms
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),  # terms
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
]
# a wrapped line of a licence may begin with the word itself: a notice has a mark, a year or a name after "by"
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n©]*(?:copyright[ \t]*(?:\(c\)|©|:|[0-9]{4}|by[ \t])|\(c\)[ \t]*[0-9]|c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*"
TITLE = r"(?m)^[^\p{L}\p{N}\n]*(?:the )?(?:mit|isc|zlib|(?:new |modified |simplified )?bsd(?:[ -][23][ -]clause)?(?: [\"'(][a-z]+[\"')](?: or [\"'(][a-z]+[\"')])?)?) licen[cs]e(?: \((?:mit|isc|bsd|expat)[^)\n]*\))?[^\p{L}\p{N}\n]*$"
OTHER = r"[^\p{L}\p{N}\n]+"
PARAGRAPH = r"\n(?: *\n)+"


def canonical(text: str = "text") -> Column:
    """The canonical lines of a text, each between spaces, parted by line ends."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), COPYRIGHT, ""), TITLE, ""), OTHER, " ")
    out = F.concat(F.lit(" "), F.replace(out, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return out


def one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def digest(line: Column) -> Column:
    return F.when(line != "", F.sha2(line, 256))


def known_digests(licenses: DataFrame) -> DataFrame:
    """``license, digest`` of a table ``license, text``."""
    return licenses.select("license", digest(one_line(canonical())).alias("digest")).where("digest is not null").distinct()


def known(spark: SparkSession) -> DataFrame:
    """``license, digest`` of the licences known without a table."""
    return known_digests(_listed(spark, KNOWN, "text")).union(_listed(spark, DIGESTS, "digest")).distinct()


def _listed(spark: SparkSession, pairs: list[tuple[str, str]], value: str) -> DataFrame:
    """A short list as a table, without Python workers."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(x).alias(value)) for name, x in pairs])
    return spark.range(1).select(F.inline(rows))


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """``doc_id, text_digest, license, notices``: licences that the whole text is, and those that paragraphs or lines name."""
    digests = stored(known(docs.sparkSession) if licenses is None else known_digests(licenses), "known-licenses")
    rows = docs.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row_key"), canonical().alias("lines"))
    lines = F.transform(F.split("lines", "\n"), lambda x: digest(F.trim(F.regexp_replace(x, " +", " "))))
    paragraphs = F.filter(F.split("lines", PARAGRAPH), lambda x: F.contains(F.trim(x), F.lit("\n")))  # others are lines
    parts = F.concat(lines, F.transform(paragraphs, lambda x: digest(one_line(x))))
    rows = stored(rows.select("doc_id", "row_key", digest(one_line(F.col("lines"))).alias("text_digest"), F.array_distinct(F.filter(parts, lambda x: x.isNotNull())).alias("part_digests")), "digests")
    marks = rows.select("row_key", F.explode("part_digests").alias("digest"), F.lit(1).alias("part")).union(rows.where("text_digest is not null").select("row_key", "text_digest", F.lit(0)))
    found = marks.join(small(digests), "digest").groupBy("row_key").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("part") == 0, F.col("license")))), ",").alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("part") == 1, F.col("license")))), ",").alias("notices"),
    )
    out = rows.select("doc_id", "row_key", "text_digest").join(found, "row_key", "left")
    return out.select("doc_id", "text_digest", F.coalesce("license", F.lit("")).alias("license"), F.coalesce("notices", F.lit("")).alias("notices"))


def sql(documents: str = "documents") -> str:
    """The scan as DuckDB SQL."""

    def quoted(s):
        return "'" + s.replace("'", "''") + "'"

    def canon(column):
        out = f"regexp_replace(regexp_replace(regexp_replace(lower(coalesce({column}, '')), {quoted(COPYRIGHT)}, '', 'g'), {quoted(TITLE)}, '', 'g'), {quoted(OTHER)}, ' ', 'g')"
        out = f"' ' || replace({out}, chr(10), ' ' || chr(10) || ' ') || ' '"
        for old, new in SPELLINGS:
            out = f"replace({out}, ' {old} ', ' {new} ')"
        return out

    whole = "trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'))"
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in KNOWN)
    given = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in DIGESTS)
    part = whole.replace("lines", "p")
    return f"""
with known as (select distinct license, sha256({whole}) as digest from (select license, {canon("text")} as lines from (values {values}) v(license, text)) c where {whole} <> '' union select license, digest from (values {given}) g(license, digest)),
rows as (select doc_id, row_number() over () as rk, {canon("text")} as lines from {documents}),
marks as (select rk, case when {whole} <> '' then sha256({whole}) end as digest, 0 as line from rows
  union all select rk, sha256(l) as digest, 1 as line from (select rk, trim(regexp_replace(x, ' +', ' ', 'g')) as l from (select rk, unnest(string_split(lines, chr(10))) as x from rows) u) t where l <> ''
  union all select rk, sha256({part}) as digest, 1 as line from (select rk, unnest(string_split_regex(lines, {quoted(PARAGRAPH)})) as p from rows) w where contains(trim(p), chr(10)) and {part} <> ''),
found as (select rk, string_agg(distinct case when line = 0 then license end, ',' order by case when line = 0 then license end) as license,
  string_agg(distinct case when line = 1 then license end, ',' order by case when line = 1 then license end) as notices from marks join known using (digest) group by rk)
select doc_id, case when {whole} <> '' then sha256({whole}) end as text_digest, coalesce(license, '') as license, coalesce(notices, '') as notices from rows left join found using (rk)"""
