"""License scans: canonical digests of whole texts and of their notices, hash-joined to known digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablescope.llm.text import col

#: Wordings of licence notices and short licences, by SPDX name.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
        by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    ),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]
#: Spellings that count as one.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("noncommercial", "non commercial"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
]
#: Lines that name the holder of a copyright, not the licence.
COPYRIGHT = r"^[ \t#*/;-]*(?:copyright|\(c\)|©)[ \t:]*(?:\(c\)|©|[0-9]|copyright|by).*$"


def canonical_line(line: Column) -> Column:
    """Lower case and single blanks for all but letters and digits; nothing of a copyright line."""
    low = F.lower(line)
    return F.trim(F.regexp_replace(F.when(~low.rlike(COPYRIGHT), low).otherwise(""), r"[^\p{L}\p{N}]+", " "))


def one_spelling(text: Column) -> Column:
    """Every word between two blanks of its own, so that plain replacement finds whole words."""
    text = F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" "))
    for variant, usual in SPELLINGS:
        variant, usual = (f" {x.replace(' ', '  ')} " for x in (variant, usual))
        text = F.replace(text, F.lit(variant), F.lit(usual))
    return text


def digest(canonical: Column) -> Column:
    """SHA-256 of a canonical text in one spelling; null if nothing is left of it."""
    return F.when(canonical != "", F.sha2(one_spelling(canonical).cast("binary"), 256))


def digests(text: Column) -> Column:
    """``digest, whole`` for the whole text and for each of its lines."""
    lines = F.transform(F.split(text, "\n"), canonical_line)
    whole = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    each = F.transform(F.array_distinct(lines), lambda x: F.struct(digest(x).alias("digest"), F.lit(False).alias("whole")))
    return F.concat(F.array(F.struct(digest(whole).alias("digest"), F.lit(True).alias("whole"))), each)


def known_licenses(spark: SparkSession) -> DataFrame:
    """The built-in wordings as ``license, text``."""
    return spark.createDataFrame(KNOWN, "license string, text string")


def scan_licenses(
    docs: DataFrame, licenses: DataFrame, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with ``license`` and ``notices``.

    ``licenses`` has ``license`` and ``text``.  ``license`` is the known licence
    that the whole text is, up to case, punctuation, copyright lines and
    spellings, else null; ``notices`` are the sorted licences that it or a single
    line of it is.

    A null or blank text is no licence.  Repeated rows stay.  Of known wordings with one digest the smallest name counts.  Empty tables give no rows
    or no licences.  Input columns with the names of results are replaced.
    """
    names = ["license", "notices"]
    kept = [c for c in docs.columns if c.lower() not in names and (keep is None or c in keep)]
    known = licenses.select(F.element_at(digests(F.col("text")), 1)["digest"].alias("digest"), F.col("license").alias("name"))
    known = known.where("digest is not null").groupBy("digest").agg(F.min("name").alias("name"))
    source = docs.where(col(text).isNotNull())
    rows = source.select(F.unhex(F.md5(col(text).cast("binary"))).alias("__llm_key"), F.inline(digests(col(text))))
    met = rows.where("digest is not null").join(known, "digest")
    found = met.groupBy("__llm_key").agg(
        F.min(F.when(F.col("whole"), F.col("name"))).alias("license"), F.sort_array(F.collect_set("name")).alias("notices")
    )
    out = docs.select(*[col(c) for c in kept], F.unhex(F.md5(col(text).cast("binary"))).alias("__llm_key"))
    out = out.join(found, "__llm_key", "left")
    none = F.array().cast("array<string>")
    return out.select(*[col(c) for c in kept], "license", F.coalesce("notices", none).alias("notices"))
