r"""Licence scans in DataFrame functions only.

A text is normalised once: lower case, every run of other than letters and digits is one
space, with sentence and line ends kept apart. Units are its lines and up to LINES
neighbouring lines, its sentences, which may go on over line ends, and up to SENTENCES
neighbouring ones of a paragraph (between blank lines), pieces between any two of these
ends, paragraphs, and the text as a whole. A unit is compared with licence templates by
the Dice coefficient over bags of word bigrams,
2 * shared / (bigrams of the unit + bigrams of the template), and matches the best of
those that reach the threshold, so a version or variant of a licence names no other.

Size bounds prune: a unit of a bigrams can reach the threshold d with a template of b only
if d / (2 - d) * b <= a <= (2 - d) / d * b, so units that fit no template are dropped
before a bigram is made, and others meet the templates that they fit. Templates are
literals in the plan, their number and size are fixed; nothing is shuffled or joined.

Every match holds one of a few anchor words, so neighbours are put together around these
only. Defined cases: a null text counts as empty; texts without a unit that fits have no
licence (null, score 0, no matches); units of one word have no bigram and match nothing;
ties in score go to the template name that comes first; a repeated row is scanned as often
as it comes; a null doc_id is kept; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import table, text_or_empty

THRESHOLD = 0.8
#: d / (2 - d) in whole numbers: units at a bound of size would be lost to the rounding of doubles.
LESS, MORE = (Fraction(str(THRESHOLD)) / (2 - Fraction(str(THRESHOLD)))).as_integer_ratio()
#: Neighbouring lines and sentences that make a unit, at most.
LINES, SENTENCES = 10, 3
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = _BSD + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Licence notices and short licences as they are usually given.
TEMPLATES = {
    "MIT/notice": "Released under the MIT License.",
    "MIT/licensed": "Licensed under the MIT License.",
    "MIT/text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0/notice": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0/notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "BSD/notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD/text": _BSD,
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense/text": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0/work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All-rights-reserved/notice": "All rights reserved.",
}


def bigrams_of(text: str) -> Counter[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return Counter(" ".join(p) for p in zip(words, words[1:], strict=False))


TEMPLATES |= {
    "MIT/whole": TEMPLATES["MIT/text"] + " " + _WARRANTY,
    "BSD-2-Clause/whole": _BSD_TWO + _BSD_END,
    "BSD-3-Clause/whole": _BSD_TWO + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + _BSD_END,
    "ISC/whole": TEMPLATES["ISC/text"] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib/whole": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: Name, bigrams in all, (bigram, count) of each template, in order of name.
BAGS = [(name, sum(bag.values()), sorted(bag.items())) for name, bag in ((n, bigrams_of(t)) for n, t in sorted(TEMPLATES.items()))]


def normalised(text: Column) -> Column:
    """Lower case words with single spaces; line ends are \\n, sentence ends \\x02."""
    ends = F.regexp_replace(F.regexp_replace(F.lower(text), r"[.!?]+[ \t]*\n", "\x02\n"), r"[.!?]+[ \t]+", "\x02")
    return F.regexp_replace(ends, r"[^\p{L}\p{N}\n\x02]+", " ")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matched(unit: Column) -> Column:
    """(-score, name) of the template that a unit matches, or null."""
    bag = _let(F.split(unit, " "), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))
    # A bigram and how often it has come make a key, so shared keys are the shared part of two bags.
    keyed = _let(bag, lambda b: F.transform(b, lambda g, i: F.concat_ws("#", g, F.size(F.filter(F.slice(b, 1, i + 1), lambda x: x == g)).cast("string"))))
    of: dict[str, list[int]] = {}
    for t, (_, _, entries) in enumerate(BAGS):
        for g, n in entries:
            for k in range(n):
                of.setdefault(f"{g}#{k + 1}", []).append(t)
    lookup = F.create_map(*(c for k, ts in sorted(of.items()) for c in (F.lit(k), F.array(*map(F.lit, ts)))))
    names, sizes = F.array(*(F.lit(name) for name, _, _ in BAGS)), F.array(*(F.lit(b) for _, b, _ in BAGS))

    def scores(keys: Column) -> Column:
        hits = F.flatten(F.transform(F.filter(keys, lambda k: F.map_contains_key(lookup, k)), lambda k: F.element_at(lookup, k)))
        return _let(hits, lambda h: F.transform(F.array_distinct(h), lambda t: score(F.size(keys), F.size(F.filter(h, lambda x: x == t)), t)))

    def score(a: Column, shared: Column, t: Column) -> Column:
        b = F.get(sizes, t)
        fits = (a * MORE >= b * LESS) & (a * LESS <= b * MORE)
        return F.when(fits, F.struct((-2.0 * shared / (a + b)).alias("less"), F.get(names, t).alias("name")))

    return F.array_min(F.filter(_let(keyed, scores), lambda m: m["less"] <= -THRESHOLD))


def _spaces(u: Column) -> Column:
    return F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))


def _neighbours(parts: Column, most: int) -> Column:
    """Up to `most` neighbouring parts put together, around those that hold an anchor; none that is too long for any template. Parts have single spaces inside."""
    long = MORE * max(b for _, b, _ in BAGS) // LESS

    def around(x: Column) -> Column:
        """x: text, size and whether it holds an anchor of each part. A part may have a space at either end that is trimmed later."""
        fits = lambda i, n: F.aggregate(F.slice(x, i, n), F.lit(0), lambda s, part: s + part["size"] - 2) <= long
        joined = lambda i: F.transform(F.filter(F.sequence(F.lit(1), F.least(F.lit(most), F.size(x) - i + 1)), lambda n: fits(i, n)), lambda n: F.array_join(F.transform(F.slice(x, i, n), lambda part: part["text"]), " "))
        starts = F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: F.exists(F.slice(x, i, most), lambda part: part["held"]))
        return F.flatten(F.transform(starts, joined))

    return _let(F.transform(parts, lambda p: F.struct(p.alias("text"), _spaces(p).alias("size"), p.rlike(_ANCHORS).alias("held"))), around)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license (of the best match), score, n_matches (matching units) and licenses (all, sorted) of each row."""
    least, most = min(b for _, b, _ in BAGS), max(b for _, b, _ in BAGS)
    # A text without any of the words has no unit that matches, so it is not looked at further.
    low = docs.select("doc_id", F.lower(text_or_empty()).alias("low"))
    low = low.select("doc_id", F.when(F.col("low").rlike(_ANYWHERE), F.col("low")).otherwise(F.lit("")).alias("low"))
    rows = low.select("doc_id", normalised(F.col("low")).alias("t"))
    fold = lambda c: F.translate(c, "\n", " ")
    join = lambda c: F.translate(c, "\x02", " ")
    single = lambda c: F.regexp_replace(c, " +", " ")
    rows = rows.select("doc_id", "t", F.split("t", "\n(?: *\n)+").alias("paragraphs"))
    parts = F.concat(
        F.split("t", "[\n\x02]"),
        _neighbours(F.split(single(join("t")), "\n"), LINES),
        F.flatten(F.transform("paragraphs", lambda p: _neighbours(F.split(single(fold(p)), "\x02"), SENTENCES))),
        F.transform("paragraphs", lambda p: fold(join(p))),
        F.array(fold(join("t"))),
    )
    # The size bounds first, then one look for a word that some template has; few units are left to be trimmed and compared.
    parts = F.filter(parts, lambda u: (F.length(u) > 2) & (_spaces(u) * MORE >= LESS * least))
    trimmed = F.transform(F.filter(parts, lambda u: u.rlike(_ANCHORS)), lambda x: F.trim(F.regexp_replace(x, " +", " ")))
    fit = F.filter(F.array_distinct(trimmed), lambda u: (_spaces(u) >= 1) & (_spaces(u) * MORE >= LESS * least) & (_spaces(u) * LESS <= MORE * most))
    # A match shares d / (2 - d) of the unit's bigrams at least, so as many of its words are words of templates.
    vocabulary = sorted({w for _, _, entries in BAGS for gram, _ in entries for w in gram.split(" ")})
    fit = F.filter(fit, lambda u: F.size(F.filter(F.split(u, " "), lambda w: w.isin(*vocabulary))) * MORE >= LESS * _spaces(u))
    rows = rows.select("doc_id", F.filter(F.transform(fit, _matched), lambda m: m.isNotNull()).alias("every"))
    rows = rows.select("doc_id", F.size("every").cast("long").alias("n_matches"), "every")
    best, names = F.array_min("every"), F.array_sort(F.array_distinct(F.transform("every", lambda m: m["name"])))
    return rows.select("doc_id", best["name"].alias("license"), F.coalesce(-best["less"], F.lit(0.0)).alias("score"), "n_matches", F.concat_ws(",", names).alias("licenses"))


def anchors() -> list[str]:
    """Words of which every unit that matches a template holds one.

    A match shares at least d / (2 - d) of a template's b bigrams, so it lacks at most
    b - d / (2 - d) * b of them: words that cover one bigram more cannot all be missing.
    Long words come first, as they are rare in other texts.
    """
    words: set[str] = set()
    for _, b, entries in BAGS:
        need, left = int(b - THRESHOLD / (2 - THRESHOLD) * b + 1e-9) + 1, dict(entries)
        while need > 0:
            cover: Counter[str] = Counter()
            for gram, n in left.items():
                for w in set(gram.split(" ")):
                    cover[w] += n
            w = max(cover, key=lambda w: (w in words, len(w) > 5, min(cover[w], need), len(w), w))
            words.add(w)
            need -= cover[w]
            left = {g: n for g, n in left.items() if w not in g.split(" ")}
    return sorted(words)


_ANCHORS = r"(?:^| )(?:" + "|".join(anchors()) + r")(?: |$)"
#: The same in a text that is not yet normalised; long words match within words too, which only costs time.
_ANYWHERE = "|".join(w if len(w) > 4 else f"(?<![a-z0-9]){w}(?![a-z0-9])" for w in anchors())


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, {b}, {quoted(g)}, {n})" for name, b, entries in BAGS for g, n in entries)
    d = THRESHOLD
    return rf"""
WITH template(name, b, gram, n) AS (VALUES {rows}),
size AS (SELECT DISTINCT name, b FROM template),
t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?]+[ \t]*\n', chr(2) || chr(10), 'g'), '[.!?]+[ \t]+', chr(2), 'g'), '[^\p{{L}}\p{{N}}\n\x02]+', ' ', 'g') AS t FROM documents
),
lines AS (SELECT r, string_split(replace(t, chr(2), ' '), chr(10)) AS p, {LINES} AS most FROM t),
paragraph AS (SELECT r, unnest(regexp_split_to_array(t, '\n(?: *\n)+')) AS x FROM t),
series AS (SELECT * FROM lines UNION ALL SELECT r, string_split(replace(x, chr(10), ' '), chr(2)), {SENTENCES} FROM paragraph),
started AS (SELECT r, p, most, unnest(range(1, len(p) + 1)) AS i FROM series),
raw AS (
  SELECT r, unnest(regexp_split_to_array(t, '[\n\x02]')) AS u FROM t
  UNION ALL SELECT r, array_to_string(p[i:i + n - 1], ' ') FROM started, (SELECT unnest(range(1, {max(LINES, SENTENCES)} + 1)) AS n) WHERE n <= most AND i + n - 1 <= len(p)
  UNION ALL SELECT r, replace(replace(x, chr(10), ' '), chr(2), ' ') FROM paragraph
  UNION ALL SELECT r, replace(replace(t, chr(10), ' '), chr(2), ' ') FROM t
),
unit AS (SELECT DISTINCT r, trim(regexp_replace(u, ' +', ' ', 'g')) AS u FROM raw),
words AS (SELECT r, u, string_split(u, ' ') AS w FROM unit),
fit AS (SELECT *, len(w) - 1 AS a FROM words WHERE len(w) > 1 AND EXISTS (SELECT 1 FROM size s WHERE (len(words.w) - 1) * {2 - d} >= {d} * s.b AND (len(words.w) - 1) * {d} <= {2 - d} * s.b)),
grams AS (SELECT r, u, a, unnest(list_transform(range(1, a + 1), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM fit),
counted AS (SELECT r, u, a, gram, count(*) AS n FROM grams GROUP BY ALL),
scored AS (
  SELECT c.r, c.u, p.name, 2.0::DOUBLE * sum(least(c.n, p.n)) / (c.a + p.b) AS score
  FROM counted c JOIN template p ON c.gram = p.gram
  WHERE c.a * {2 - d} >= {d} * p.b AND c.a * {d} <= {2 - d} * p.b GROUP BY c.r, c.u, p.name, c.a, p.b
),
matched AS (SELECT r, u, arg_min(name, (-score, name)) AS name, max(score) AS score FROM scored WHERE score >= {d} GROUP BY r, u),
best AS (
  SELECT r, arg_min(name, (-score, name)) AS license, max(score) AS score, count(DISTINCT u) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM matched GROUP BY r
)
SELECT t.doc_id, best.license, coalesce(best.score, 0)::DOUBLE AS score, coalesce(best.n_matches, 0) AS n_matches, coalesce(best.licenses, '') AS licenses
FROM t LEFT JOIN best USING (r)
"""


SQL = _sql()
