"""Known licences by the digest of their canonical text.

Canonical: A-Z lower-cased; copyright lines (with a year, (c) or the sign) and "all rights reserved" lines dropped; everything
but letters and digits one space; equivalent spellings made alike. The SHA-256 of a whole text so treated is hash-joined to
those of known licences. A document's lines that speak of a licence are looked up likewise among known notices; an
SPDX-License-Identifier line gives the expression that it names.
Only built-in functions are used. The table of known texts is fixed and small, so that it is broadcast.

Cases: a null text counts as empty; an empty canonical text matches nothing; repeated rows are judged alike; very long
texts are taken whole; an empty table gives an empty result; other columns are dropped by name before any are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equivalent spellings, as whole words of canonical text.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licenses", "sublicenses"), ("non commercial", "noncommercial"), ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("whilst", "while"), ("per cent", "percent"), ("favour", "favor"), ("https", "http"), ("merchantibility", "merchantability"),
]
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[^a-z0-9\n]*((\(c\)|©)[^\n]*|[0-9]{4}[^\n]*)|(\(c\)|©)[^\n]*[0-9]{4}[^\n]*|all rights reserved[^a-z0-9\n]*)$"

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
# Public licence texts without their copyright lines, by SPDX id.
LICENSES = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC_HEAD + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_TAIL),
    ("ISC", "ISC License\n\n" + _ISC_HEAD + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_TAIL),
    ("0BSD", _ISC_HEAD + "." + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + _BSD_TAIL),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    ("MIT-0", _MIT.replace(", subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".")),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    ),
    (
        "BSL-1.0",
        """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
]
# Digests of long public texts, by SPDX id (a text alone doesn't tell "only" from "or later"; the former stands for both):
# those of Debian's common licences; whole, with the copyright line of its appendix filled in (and thus dropped), and the terms alone,
# with or without "END OF TERMS AND CONDITIONS".
DIGESTS = [
    ("Apache-2.0", "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3"),  # whole
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),  # appendix filled in
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),  # terms with end line
    ("Apache-2.0", "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64"),  # terms
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),  # whole
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),  # whole
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),  # whole
    ("GFDL-1.2-only", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),  # whole
    ("GFDL-1.3-only", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),  # whole
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),  # whole
    ("GPL-1.0-only", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),  # terms with end line
    ("GPL-1.0-only", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),  # terms
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),  # whole
    ("GPL-2.0-only", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),  # terms with end line
    ("GPL-2.0-only", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),  # terms
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),  # whole
    ("GPL-3.0-only", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),  # terms with end line
    ("GPL-3.0-only", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),  # terms
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),  # whole
    ("LGPL-2.0-only", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),  # terms with end line
    ("LGPL-2.0-only", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),  # terms
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),  # whole
    ("LGPL-2.1-only", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),  # terms with end line
    ("LGPL-2.1-only", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),  # terms
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),  # whole
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),  # whole
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),  # whole
]
# One-line notices, by SPDX id.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
# Further wordings, by SPDX id.
WORDINGS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
]
#: The line names a licence expression itself.
TAGGED = r"SPDX-License-Identifier:\s*(\(*[A-Za-z0-9][A-Za-z0-9.+:-]*\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][A-Za-z0-9.+:-]*\)*)*)"


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def canonical(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # two spaces between words, so that each has its own: neighbours are both replaced
    out = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(lower, COPYRIGHT_LINE, ""), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(_spaced(a)), F.lit(_spaced(b)))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def scan_licenses(df: DataFrame, id_col: str, text_col: str, licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    """id_col, digest, license (null: unknown) and notices (distinct ids in order, comma-joined) of each row of df."""
    spark = df.sparkSession
    texts = [(a, digest(F.lit(b))) for a, b in licenses or LICENSES] + [(a, F.lit(d)) for a, d in ([] if licenses else DIGESTS)]
    listed = F.array(*(F.struct(F.lit(a).alias("license"), d.alias("digest")) for a, d in texts))
    known = spark.range(1).select(F.inline(listed)).groupBy("digest").agg(F.min("license").alias("license"))
    table = F.create_map(*(x for name, body in NOTICES + WORDINGS for x in (digest(F.lit(body)), F.lit(name))))
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    lines = F.filter(F.split(F.coalesce("_text", F.lit("")), "\n"), lambda x: F.lower(x).contains("licen"))
    found = F.filter(F.transform(lines, lambda x: F.coalesce(F.nullif(F.regexp_extract(x, TAGGED, 1), F.lit("")), F.try_element_at(table, digest(x)))), lambda x: x.isNotNull())
    notice = F.when(F.lower("_text").contains("licen"), F.array_join(F.array_sort(F.array_distinct(found)), ",")).otherwise("")
    judged = rows.select(id_col, digest(F.col("_text")).alias("digest"), notice.alias("notices"))
    return judged.join(F.broadcast(known), "digest", "left").select(id_col, "digest", "license", "notices")


def _sql(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"' ' || regexp_replace(regexp_replace({lower}, {quote(COPYRIGHT_LINE)}, '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{_spaced(a)}', '{_spaced(b)}')"
    return f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g')))"


def oracle() -> str:
    """The same for the documents table, in SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = lambda rows: ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows)
    return f"""
        WITH known AS (SELECT {_sql('body')} AS digest, min(license) AS license FROM (VALUES {values(LICENSES)}) t(license, body) GROUP BY 1),
        notice AS (SELECT {_sql('body')} AS digest, min(license) AS license FROM (VALUES {values(NOTICES)}) t(license, body) GROUP BY 1),
        lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
        found AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT doc_id, {_sql('line')} AS digest FROM lines WHERE contains(lower(line), 'licen')) x JOIN notice USING (digest) GROUP BY doc_id)
        SELECT d.doc_id, d.digest, license, coalesce(notices, '') AS notices
        FROM (SELECT doc_id, {_sql('text')} AS digest FROM documents) d LEFT JOIN known ON d.digest = known.digest LEFT JOIN found ON d.doc_id = found.doc_id"""
