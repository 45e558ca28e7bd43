"""License scans: normalised units of a text against licence templates, by Dice coefficient over distinct word bigrams.

Units are lines, blocks between blank lines and the whole text, so a notice is found wherever it stands alone. Size
bounds prune first: at p percent, a unit of s bigrams can only reach a template of b bigrams if p * b <= (200 - p) * s
and p * s <= (200 - p) * b. All comparisons are of integers, so what lies exactly at the threshold counts. Texts and
units without any word that a match must have are passed over first. DataFrame functions only, and no shuffle: each row
is judged by itself, whole, however long its units.

Null, empty and licence-free texts have a null license, dice 0 and no matched units. A tie goes to the first template.
Repeated rows give repeated results, empty tables none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Licence ids with public notices and texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved."),
)


@dataclass(frozen=True)
class LicenseParams:
    """percent: the least Dice coefficient."""

    percent: int = 80


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, normalised like the texts."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, percent: int) -> tuple[int, int]:
    """The least and most distinct bigrams of a unit that can reach a template with `size` of them."""
    return -(-percent * size // (200 - percent)), (200 - percent) * size // percent


def needed_words(percent: int) -> list[str]:
    """Words of which every text that reaches the threshold with any template has one.

    Such a text shares at least p / (200 - p) of a template's bigrams. So words that stand in more than the rest of them
    cannot all be missing; for each template its longest words are taken until they do.
    """
    found = set()
    for _, text in TEMPLATES:
        own = bigrams(text)
        left = set(own)
        for word in sorted({w for b in own for w in b.split()}, key=lambda w: (-len(w), w)):
            if (200 - percent) * len(left) < percent * len(own):
                break
            found.add(word)
            left = {b for b in left if word not in b.split()}
    return sorted(found)


def unit_matches(text: Column, params: LicenseParams = LicenseParams()) -> Column:
    """Structs (dice, template) of the units that reach the threshold, the best template of each."""
    known = [bigrams(t) for _, t in TEMPLATES]
    limits = [bounds(len(b), params.percent) for b in known]
    low, high = min(lo for lo, _ in limits), max(hi for _, hi in limits)
    vocabulary = F.array(*(F.lit(b) for b in sorted({b for found in known for b in found})))

    def against(found: Column) -> Column:
        """The largest (dice, -template) of a unit's bigrams."""
        each = []
        for k, (own, (lo, hi)) in enumerate(zip(known, limits, strict=True)):
            shared = F.size(F.array_intersect(found, F.array(*(F.lit(b) for b in own))))
            dice = 2.0 * shared / (F.size(found) + len(own))
            reached = 200 * shared >= params.percent * (F.size(found) + len(own))
            each.append(F.when(F.size(found).between(lo, hi) & reached, F.struct(dice.alias("dice"), F.lit(-k).alias("template"))))
        return F.array_max(F.array_compact(F.array(*each)))

    def scan(unit: Column) -> Column:
        words = F.filter(F.split(unit, "[ \n]+"), lambda w: w != "")
        pairs = F.transform(F.array(words), lambda w: F.when(F.size(w) > max(1, low), F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))))
        return F.transform(pairs, lambda b: F.when(F.size(b).between(low, high) & F.arrays_overlap(b, vocabulary), against(b)))[0]

    normal = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    needed = "(?:^|[ \n])(?:" + "|".join(needed_words(params.percent)) + ")(?:[ \n]|$)"
    units = lambda t: F.filter(F.array_distinct(F.concat(F.split(t, "\n"), F.split(t, "\n *\n[ \n]*"), F.array(t))), lambda u: u.rlike(needed))
    return F.transform(F.array(normal), lambda t: F.when(t.rlike(needed), F.filter(F.transform(units(t), scan), lambda m: m.isNotNull())).otherwise(F.array().cast("array<struct<dice:double,template:int>>")))[0]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", params: LicenseParams = LicenseParams()) -> DataFrame:
    """key, the best license, its dice, the number of units that match a template, and all licenses found."""
    ids = F.array(*(F.lit(i) for i, _ in TEMPLATES))
    found = docs.select(F.col(key).alias(key), unit_matches(F.col(text), params).alias("m"))
    best = F.array_max("m")
    return found.select(
        key,
        F.get(ids, -best["template"]).alias("license"),
        F.round(F.coalesce(best["dice"], F.lit(0.0)), 6).alias("dice"),
        F.size("m").cast("long").alias("n_units"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda m: F.get(ids, -m["template"])))), ",").alias("licenses"),
    )


def oracle(params: LicenseParams = LicenseParams()) -> str:
    """The same result in DuckDB's SQL, by plain comparison of all units with all templates."""
    rows = ", ".join(f"({k}, '{i}', ['" + "', '".join(bigrams(t)) + "'])" for k, (i, t) in enumerate(TEMPLATES))
    return f"""
WITH templates(k, id, own) AS (VALUES {rows}),
units AS (
  SELECT doc_id, unnest(list_distinct(string_split(t, chr(10)) || string_split_regex(t, '\\n *\\n[ \\n]*') || [t])) AS unit
  FROM (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS t FROM documents)
),
words AS (SELECT doc_id, unit, list_filter(string_split_regex(unit, '[ \\n]+'), lambda w: w <> '') AS w FROM units),
pairs AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) >= 2),
scored AS (
  SELECT doc_id, unit, k, id, len(list_intersect(b, own)) AS shared, len(b) + len(own) AS both
  FROM pairs JOIN templates ON {params.percent} * len(own) <= (200 - {params.percent}) * len(b) AND {params.percent} * len(b) <= (200 - {params.percent}) * len(own)
),
reached AS (SELECT *, 2.0 * shared / both AS dice FROM scored WHERE 200 * shared >= {params.percent} * both),
best AS (SELECT doc_id, unit, max(dice) AS dice, arg_max(id, [dice, -k]) AS id, arg_max(k, [dice, -k]) AS k FROM reached GROUP BY doc_id, unit),
found AS (SELECT doc_id, arg_max(id, [dice, -k]) AS license, max(dice) AS dice, count(*) AS n_units, string_agg(DISTINCT id, ',' ORDER BY id) AS licenses FROM best GROUP BY doc_id)
SELECT d.doc_id, license, round(coalesce(dice, 0.0), 6) AS dice, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN found USING (doc_id)"""


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
