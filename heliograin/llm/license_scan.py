"""Operator 7: licence scans by the Dice coefficient over word bigrams.

Texts and licence templates are normalised alike (lower case, every run of
characters other than letters and digits as one space, so line ends and comment marks
vanish) and compared as sets of word bigrams: 2 * |both| / (|a| + |b|). What
meets a template is a window of the text with as many words as the template, wherever it
lies: a notice in a longer line, wrapped over several lines, or a whole licence text.

A Dice coefficient of t needs t / (2 - t) of the template's bigrams in the window, and set
sizes within that factor of each other. So of any set of bigrams that is larger
than the rest that may be missing, every match holds one: windows are tried only
where such a telling bigram of a template stands, with the start that its place
in the template implies; templates whose size bounds the window can't
meet are passed over; and texts without any telling word are dropped before their bigrams are made.
Of windows that overlap the best one counts (higher Dice, then the
earlier template, then the earlier start).

Only DataFrame functions are used, inside each row; nothing is joined, shuffled or exploded but the
matches. Templates are a parameter, a list or a table of at most ``MOST_TEMPLATES``
rows; they become literals of the plan.

Defined results: a null or empty text, or one without a match, gives no row;
texts of one word have no bigram and never match; repeated rows add their
matches under their id; an empty table gives an empty result; further columns
are ignored whatever their names.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

THRESHOLD = 0.8
MOST_TEMPLATES = 500

# Words that ordinary prose is full of.
COMMON = {"a", "and", "any", "are", "as", "at", "by", "can", "either", "except", "following", "in", "is", "it", "may", "not", "of", "or", "that", "the", "this", "to", "under", "use", "with", "without", "you", "your"}

# Customary licence notices and licence texts, one template a text; a name may have several.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free
Software Foundation, either version {1} of the License, or (at your option) any later version."""
TEMPLATES = [
    ("AGPL-3.0", _GPL_NOTICE.format("Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_ENDORSE} {_BSD_WARRANTY}"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL_NOTICE.format("General Public License", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL_NOTICE.format("General Public License", "3")),
    (
        "ISC",
        f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    ),
    ("LGPL-2.1", _GPL_NOTICE.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GPL_NOTICE.format("Lesser General Public License", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
    ),
]


#: Keeps starts before the text's first word above zero.
LIFT = 1 << 20


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def telling(w: list[str], threshold: float) -> list[str]:
    """Bigrams of which any window that reaches the threshold holds at least one; rare words are preferred.

    Such a window has threshold / (2 - threshold) of the template's bigrams, so
    it can't lack all bigrams of a set that is larger than the rest.
    """
    grams = {f"{a} {b}" for a, b in zip(w, w[1:])}
    spare = len(grams) - math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
    return sorted(grams, key=lambda g: (-len(rarer(g)), g))[: spare + 1]


def rarer(gram: str) -> str:
    """The word of a bigram that prose is less full of: the longest that isn't common, if any."""
    a, b = gram.split(" ")
    left = [x for x in (a, b) if x not in COMMON]
    return max(left, key=lambda x: (len(x), x)) if left else ""


def prepared(templates, threshold: float) -> list[dict]:
    """Name, words, distinct bigrams and (telling bigram, place) of each template; of a list of pairs or a table (license, text)."""
    if isinstance(templates, DataFrame):
        templates = [tuple(r) for r in templates.select("license", "text").filter("license is not null and text is not null").orderBy("license", "text").limit(MOST_TEMPLATES + 1).collect()]
    if not 0 < len(templates) <= MOST_TEMPLATES:
        raise ValueError(f"between 1 and {MOST_TEMPLATES} templates are asked for")
    made = []
    for name, text in templates:
        w = words_of(text)
        if len(w) > 1:
            every = [f"{a} {b}" for a, b in zip(w, w[1:])]
            chosen = set(telling(w, threshold))
            made.append({"license": name, "n": len(every), "grams": sorted(set(every)), "at": [(g, i) for i, g in enumerate(every) if g in chosen]})
    return made


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, license, dice, start, end): the windows that reach the threshold, in words of the normalised text, end exclusive."""
    made = prepared(TEMPLATES if templates is None else templates, threshold)
    places: dict[str, list] = {}
    for k, t in enumerate(made):
        for g, i in t["at"]:
            places.setdefault(g, []).append({"k": k, "o": i})
    words = sorted({rarer(g) or g.split(" ")[0] for g in places})
    ratio = threshold / (2 - threshold)
    # what a generator makes is a column of its own: filters on it aren't pushed below as copies of its expression
    column = lambda c, name: F.explode(F.array(c)).alias(name)
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    normal = F.regexp_replace(F.lower(F.col(text_col).cast("string")), r"[^\p{L}\p{N}]+", " ")
    read = docs.select(F.col(id_col).alias("id"), column(F.split(F.btrim(normal, F.lit(" ")), " "), "w"))
    read = read.filter(F.arrays_overlap("w", F.array(*map(F.lit, words))))
    grams = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    read = read.filter(F.size("w") > 1).select("id", column(grams, "b"))
    told = F.filter(F.transform("b", lambda g, i: F.when(g.isin(list(places)), F.struct(g.alias("g"), i.alias("i")))), lambda h: h.isNotNull())
    read = read.select("id", "b", column(told, "told")).filter(F.size("told") > 0)
    of, table = literal(places, "map<string,array<struct<k:int,o:int>>>"), literal(made, "array<struct<license:string,n:int,grams:array<string>>>")
    # template and start in one number, as distinct structs would be compared pair by pair
    tried = F.flatten(F.transform("told", lambda h: F.transform(F.element_at(of, h["g"]), lambda x: F.shiftleft(x["k"].cast("long"), 32) + (h["i"] - x["o"] + LIFT))))

    def scored(c):
        k, start = F.shiftright(c, 32).cast("int"), (c.bitwiseAND(F.lit((1 << 32) - 1)) - LIFT).cast("int")
        t = F.get(table, k)
        first, last = F.greatest(start, F.lit(0)), F.least(start + t["n"], F.size("b"))
        own = F.array_distinct(F.slice("b", first + 1, F.greatest(last - first, F.lit(0))))
        count, n = F.size(own), F.size(t["grams"])
        dice = F.when((count >= n * ratio) & (count * ratio <= n), F.lit(2.0) * F.size(F.array_intersect(own, t["grams"])) / (count + n))
        return F.struct(F.coalesce(dice, F.lit(0.0)).alias("dice"), (-k).alias("order"), (-first).alias("back"), (last + 1).alias("end"), t["license"].alias("license"))

    windows = read.select("id", "b", column(F.array_distinct(tried), "tried")).select("id", column(F.transform("tried", scored), "found"))
    windows = windows.select("id", column(F.filter("found", lambda x: x["dice"] >= threshold), "found")).filter(F.size("found") > 0)
    return unbeaten(windows, max((t["n"] for t in made), default=0) + 1)


def unbeaten(windows: DataFrame, longest: int) -> DataFrame:
    """Rows (id, license, dice, start, end): the windows of rows (id, found) that no overlapping one of the same row is greater than, by (dice, order, back).

    A text is cut into cells of the longest window's words. A window lies in two at
    most, and windows that overlap share one, so each is compared only inside its cells.
    """
    # texts may share an id: the row's number tells them apart, and is written as it mustn't change
    rows = C.cut(windows.withColumn("row", F.monotonically_increasing_id()).select("id", "row", F.explode("found").alias("x")))
    cell = lambda at: F.floor(at / longest)
    cells = rows.select("row", "x", F.explode(F.sequence(cell(-F.col("x.back")), cell(F.col("x.end") - 1))).alias("cell"))
    better = lambda y, x: (F.struct(y["dice"], y["order"], y["back"]) > F.struct(x["dice"], x["order"], x["back"])) & (-y["back"] < x["end"]) & (-x["back"] < y["end"])
    inside = cells.groupBy("row", "cell").agg(F.collect_list("x").alias("all"))
    beaten = inside.select("row", F.explode(F.filter("all", lambda x: F.exists("all", lambda y: better(y, x)))).alias("x"))
    named = lambda rows: rows.select("row", F.col("x.dice").alias("dice"), F.col("x.order").alias("order"), F.col("x.back").alias("back"))
    kept = rows.select("id", "row", "x.*").join(named(beaten).distinct(), ["row", "dice", "order", "back"], "left_anti")
    return kept.select("id", "license", "dice", (-F.col("back")).alias("start"), "end")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    found = matches(C.table(spark, sf_dir, "documents"))
    return found.groupBy(F.col("id").alias("doc_id"), "license").agg(
        F.count("*").alias("n_windows"), F.min("start").cast("long").alias("first_word"), F.round(F.max("dice"), 6).alias("dice")
    )


def _sql() -> str:
    made, ratio = prepared(TEMPLATES, THRESHOLD), THRESHOLD / (2 - THRESHOLD)
    rows = ", ".join(f"({k}, '{t['license']}', {t['n']}, [{', '.join(repr(g) for g in t['grams'])}])" for k, t in enumerate(made))
    at = ", ".join(f"('{g}', {k}, {i})" for k, t in enumerate(made) for g, i in t["at"])
    return rf"""
WITH templates(k, license, n, grams) AS (VALUES {rows}),
told(g, k, o) AS (VALUES {at}),
split AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), ' ') AS w FROM documents WHERE text IS NOT NULL
), read AS (
  SELECT r, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM split WHERE len(w) > 1
), hits AS (
  SELECT r, unnest(b) AS g, unnest(range(0, len(b))) AS i FROM read
), tried AS (
  SELECT DISTINCT r, k, i - o AS s FROM hits JOIN told USING (g)
), placed AS (
  SELECT r, doc_id, k, license, greatest(s, 0) AS start, least(s + n, len(b)) AS last, b, grams FROM tried JOIN read USING (r) JOIN templates USING (k)
), own AS (
  SELECT * EXCLUDE (b), list_distinct(b[start + 1 : last]) AS own FROM placed
), scored AS (
  SELECT r, doc_id, k, license, start, last + 1 AS stop, 2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice
  FROM own WHERE len(own) >= len(grams) * {ratio!r} AND len(own) * {ratio!r} <= len(grams)
), good AS (
  SELECT * FROM scored WHERE dice >= {THRESHOLD}
), best AS (
  SELECT * FROM good x WHERE NOT EXISTS (
    SELECT 1 FROM good y WHERE y.r = x.r AND (y.dice, -y.k, -y.start) > (x.dice, -x.k, -x.start) AND y.start < x.stop AND x.start < y.stop)
)
SELECT doc_id, license, count(*) AS n_windows, min(start)::BIGINT AS first_word, round(max(dice), 6) AS dice FROM best GROUP BY doc_id, license
"""


ORACLE = _sql()
