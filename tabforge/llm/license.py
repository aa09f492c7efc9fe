"""Licence scan by canonical digests, in DataFrame expressions only.

A text is put into a canonical form (case, copyright lines, spellings, punctuation, white space) and its SHA-256 looked up among
those of known licences.  Only texts that are a licence as a whole match, with or without its usual titles and its appendix.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import table
from tabforge.llm.text import LOWER, UPPER

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
#: Public licence texts, without their titles where these are optional.
KNOWN = {
    "MIT": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_AS_IS}""",
    "ISC": f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}",
    "0BSD": f"{_ISC}.\n{_ISC_END}",
    "BSD-2-Clause": f"{_TWO}\n{_BSD}",
    "BSD-3-Clause": f"{_TWO}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD}",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-Source-Notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT-Notice": "Released under the MIT License.",
    "Apache-2.0-Notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-Notice": "This work is licensed under the GNU General Public License, version 3.",
}
#: Usual titles of the licences above that have none of their own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "Expat License", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD 2-Clause \"Simplified\" License", "FreeBSD License", "BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "The New BSD License", "Modified BSD License", "Revised BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "BSD License", "BSD-3-Clause"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "Zlib"),
}
#: Whole texts with titles of their own, in the folder ``licences``: file and name.
WHOLE = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
#: Where the part that explains how to apply a licence begins; many copies end before it, some also before the closing line.
_APPENDIX = r"\n[^\n\w]*(?:APPENDIX: How to apply|(?:Appendix: )?How to Apply These Terms|ADDENDUM: How to use this License)"
_CLOSING = r"\n[^\n\w]*END OF TERMS AND CONDITIONS[^\n\w]*\s*$"
#: Former addresses of the Free Software Foundation, inside its older texts.
_ADDRESS = r"51 Franklin St(?:reet)?, Fifth Floor, Boston, MA\s+02110-1301,?\s+USA"
_FORMER = ("59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA", "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA")
#: Equivalent spellings, as whole words after lower-casing.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "catalogue": "catalog", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "noncommercial": "non commercial", "owner": "holder", "sub-license": "sublicense", "https": "http",
}
_SIGNS = {"©": "(c)", "“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "&": " and "}
_COPYRIGHT = r"(^|\n)[^\na-z0-9(]*(portions )?(copyright[ \t]*(\(c\)|[0-9<\[{]|by[ \t])|\(c\)[ \t]*[0-9<\[{])[^\n]*"
_RESERVED = r"(^|\n)[^\na-z0-9]*all rights reserved[^\na-z0-9]*"


def canonical(text: Column) -> Column:
    """The canonical form of a text; a null or empty one is empty."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for a, b in _SIGNS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(F.regexp_replace(F.replace(out, F.lit("\r"), F.lit("\n")), _COPYRIGHT, "\n"), _RESERVED, "\n")
    spelled = out
    for a, b in SPELLINGS.items():
        spelled = F.regexp_replace(spelled, rf"\b{a}\b", b)
    out = F.when(out.rlike(rf"\b(?:{'|'.join(SPELLINGS)})\b"), spelled).otherwise(out)  # most texts have none of them
    return F.trim(F.regexp_replace(out, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))


def digests(spark, known: dict[str, str] | list[tuple[str, str]]) -> DataFrame:
    """(digest, license_id) of known licence texts; of equal canonical texts the smallest name."""
    rows = spark.createDataFrame(list(known.items() if isinstance(known, dict) else known), "license_id string, text string")
    return rows.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def texts() -> list[tuple[str, str]]:
    """(license_id, text) of all that the query knows: KNOWN as it is, with its titles and without the numbers of its clauses, and
    WHOLE with and without its appendix."""
    out = list(KNOWN.items())
    for name, titles in TITLES.items():
        bodies = (KNOWN[name], re.sub(r"(?m)^\d\. ", "* ", KNOWN[name]))
        out += [(name, f"{title}\n\n{body}") for title in titles for body in bodies] + [(name, bodies[1])]
    for file, name in WHOLE.items():
        text = (Path(__file__).parent / "licences" / f"{file}.txt").read_text("utf-8")
        short = re.split(_APPENDIX, text)[0]
        for body in dict.fromkeys((text, short, re.sub(_CLOSING, "", short))):
            out += [(name, t) for t in dict.fromkeys((body, *(re.sub(_ADDRESS, a, body) for a in _FORMER)))]
    return out


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, license_id) for each row of docs; license_id is null where the text is no known licence.

    ``known`` has one row for each digest, so rows are neither lost nor doubled.  Spark broadcasts it only below its own threshold;
    beyond that digests are joined by sort-merge, with hot digests split.  Null and empty texts have the digest of the empty form.
    """
    return docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(known, "digest", "left").select("doc_id", "digest", "license_id")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), digests(spark, texts()))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    for a, b in _SIGNS.items():
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    out = f"regexp_replace(regexp_replace(replace({out}, chr(13), chr(10)), {_quoted(_COPYRIGHT)}, chr(10), 'g'), {_quoted(_RESERVED)}, chr(10), 'g')"
    for a, b in SPELLINGS.items():
        out = rf"regexp_replace({out}, '\b{a}\b', '{b}', 'g')"
    return f"trim(regexp_replace({out}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"


SQL = f"""
WITH known AS (SELECT sha256({_sql('text')}) AS digest, min(license_id) AS license_id FROM (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in KNOWN.items())}) AS t(license_id, text) GROUP BY 1),
doc AS (SELECT doc_id, sha256({_sql('text')}) AS digest FROM documents)
SELECT doc_id, digest, license_id FROM doc LEFT JOIN known USING (digest)
"""
