"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment decides.

Only DataFrame functions run on the main path. Texts become words of letters and digits, with A-Z lowered. Only texts that
hold an anchor word are cut into windows; the anchors of the templates are chosen so that a text without any of them
lacks more than a fifth of each template's shingles, so nothing that could match is passed over, and windows without an
anchor are left out for the same reason. Templates fall into classes of like length; windows are as long as the class's
longest template with a fifth to spare, and start so often that each such stretch lies within one of them. A window
is compared with the templates of its class that agree with it in one of the MinHash values of their five-word shingles. A
window that holds ``CONTAINED`` of a template's shingles has at least the Jaccard similarity j with it that follows from the sizes
of its class, and the class has as many bands as make 1 - (1 - j)^bands at least 1 - ``MISSED``. Then the share of the template's shingles in the
window is counted exactly; from ``CONTAINED`` on the text has that license.

Null and empty texts match nothing. A template shorter than five words is one shingle of all its words. One row comes
out for each id and license; repeated ids count as one, rows with a null id as one more.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import maybe_broadcast

SHINGLE = 5
CONTAINED = 0.8
MISSED = 1e-6
#: The longest template of a class is at most so many times as long as its shortest.
RATIO = 1.3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: License notices as they stand in texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


def shingles_of(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))})


def least(shingles: int) -> int:
    """How many shingles of a template make it contained."""
    return math.ceil(shingles * CONTAINED - 1e-9)


@dataclass
class Class:
    """Templates of like length, by their place in the list, and the windows and bands for them."""

    members: list[int]
    step: int
    span: int
    bands: int


def classes(templates: tuple[tuple[str, str], ...]) -> list[Class]:
    """The classes by rising length."""
    lens = [len(words_of(t)) for _, t in templates]
    rest, out = sorted(range(len(lens)), key=lambda i: lens[i]), []
    while rest:
        shortest = lens[rest[0]]
        members = [i for i in rest if lens[i] <= max(shortest * RATIO, shortest + 1)]
        rest = rest[len(members) :]
        longest, step = lens[members[-1]], max(1, shortest // 5)
        span = longest + -(-longest // 5) + step
        sizes = [len(shingles_of(words_of(templates[i][1]))) for i in members]
        similar = min(least(n) / (max(span - SHINGLE + 1, 1) + n - least(n)) for n in sizes)
        out.append(Class(members, step, span, math.ceil(math.log(MISSED) / math.log1p(-similar)) if similar < 1 else 1))
    return out


def anchors(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[str]:
    """Words such that, in every template, those shingles that hold one of them are more than a fifth of all."""
    sets = [shingles_of(words_of(t)) for _, t in templates]
    common = {"the", "of", "to", "and", "in", "a", "is", "this", "you", "may", "or", "for", "by", "it", "at", "not", "use", "with", "are", "that", "under", "without", "any", "all", "no", "be", "on"}
    found: list[str] = []

    def open_sets() -> list[list[str]]:
        hit = lambda s: sum(bool(set(x.split()) & set(found)) for x in s)
        return [s for s in sets if hit(s) <= len(s) * (1 - CONTAINED) + 1e-9]

    while left := open_sets():
        words = sorted({w for s in left for x in s for w in x.split()} - set(found))
        rare = [w for w in words if w not in common and len(w) > 2] or words
        found.append(max(rare, key=lambda w: (sum(any(w in x.split() for x in s) for s in left), len(w), w)))
    return sorted(found)


def shingled(words: Column, size: int = SHINGLE) -> Column:
    """The distinct shingles of an array of words; all words as one if they are too few."""
    last = F.greatest(F.size(words) - size + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, size), " ")))


def band_values(hashes: Column, bands: Column) -> Column:
    """The MinHash values, each with its band."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.xxhash64(b, F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b)))))


def template_table(spark, templates: tuple[tuple[str, str], ...], known: list[Class]) -> DataFrame:
    """license, class, the hashes of a template's shingles and the key of each of its bands."""
    rows = [(templates[i][0], k, own.bands, shingles_of(words_of(templates[i][1]))) for k, own in enumerate(known) for i in own.members]
    df = spark.createDataFrame(rows, "license string, class int, bands int, shingles array<string>").coalesce(1)
    df = df.select("license", "class", "bands", F.transform("shingles", lambda s: F.xxhash64(s)).alias("wanted"))
    return df.withColumn("key", F.explode(F.array_distinct(band_values(F.col("wanted"), F.col("bands"))))).drop("bands")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, the best share of a template's shingles, and the word at which the first window with a contained one starts."""
    held = anchors(templates)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.translate(text_col, UPPER, LOWER).alias("text")).where(F.col("text").rlike("|".join(held)))
    words = picked.select("doc_id", F.filter(F.split("text", "[^a-z0-9]+"), lambda w: w != "").alias("words"))
    known = classes(templates)
    # windows are numbered through all classes; without a lambda the generator and the cut stay in one compiled loop,
    # in which a text's words are not copied for each window
    ends, total = [], F.lit(0)
    for own in known:
        total = total + F.greatest(F.ceil((F.size("words") - (own.span - own.step)) / own.step), F.lit(1)).cast("int")
        ends.append(total)
    numbered = words.select("doc_id", "words", *[e.alias(f"e{k}") for k, e in enumerate(ends)])
    numbered = numbered.withColumn("i", F.explode(F.sequence(F.lit(0), F.col(f"e{len(known) - 1}") - 1)))

    def of_class(value: Callable) -> Column:
        """What holds for the class of window i."""
        return F.coalesce(*[F.when(F.col("i") < F.col(f"e{k}"), value(k)) for k in range(len(known))])

    start = of_class(lambda k: (F.col("i") - (F.col(f"e{k - 1}") if k else 0)) * known[k].step + 1)
    windows = numbered.select("doc_id", of_class(lambda k: k).alias("class"), start.alias("start"), F.slice("words", start, of_class(lambda k: known[k].span)).alias("words"), of_class(lambda k: known[k].bands).alias("bands"))
    windows = windows.where(F.arrays_overlap("words", F.array(*map(F.lit, held))))
    windows = windows.select("doc_id", "class", "start", "bands", F.transform(shingled(F.col("words")), lambda s: F.xxhash64(s)).alias("hashes"))
    windows = windows.withColumn("key", F.explode(F.array_distinct(band_values(F.col("hashes"), F.col("bands")))))
    found = windows.join(maybe_broadcast(template_table(docs.sparkSession, templates, known)), ["class", "key"])
    share = F.size(F.array_intersect("hashes", "wanted")) / F.size("wanted")
    found = found.select("doc_id", "license", "start", share.alias("containment")).where(F.col("containment") >= CONTAINED)
    out = found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"))
    return out.withColumnRenamed("doc_id", id_col)


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    """DuckDB SQL for ``scan`` over documents: every shingle of every window against every template, without bands or anchors."""
    rows = []
    for own in classes(templates):
        for i in own.members:
            shingles = shingles_of(words_of(templates[i][1]))
            rows += [f"({i}, '{templates[i][0]}', {own.step}, {own.span}, {len(shingles)}, '{x}')" for x in shingles]
    return f"""with words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z0-9]+') as w from documents),
wanted(template, license, step, span, total, shingle) as (values {", ".join(rows)}),
said as (select doc_id, cast(len(w) as bigint) as n, unnest(range(1, greatest(cast(len(w) as bigint) - {SHINGLE - 2}, 2))) as pos, w from words where len(w) > 0),
hits as (select distinct s.doc_id, s.n, s.pos, t.* from said s join wanted t on array_to_string(s.w[s.pos:s.pos + {SHINGLE - 1}], ' ') = t.shingle),
held as (select *, unnest(range(1, greatest(n - (span - step), 1) + 1, step)) as start from hits),
counted as (select doc_id, license, template, start, total, count(distinct shingle) as k from held where pos >= start and pos + least({SHINGLE - 1}, n - 1) <= start + span - 1 group by all)
select doc_id, license, max(k / total) as containment, min(start) as first_word from counted where k / total >= {CONTAINED} group by doc_id, license"""
