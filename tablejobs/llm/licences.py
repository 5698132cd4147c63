"""Licence texts and notices found in documents by Dice coefficient.

A text is normalised (lower case, runs of other signs to one space) and cut into
units: the whole text, its paragraphs (between empty lines) and its lines. A
unit is of a licence if the Dice coefficient of their sets of word bigrams,
2 |A and B| / (|A| + |B|), is at least the threshold t.

Pruning, both exact: a template of n bigrams can only reach t with units of
t / (2 - t) * n to (2 - t) / t * n bigrams, and such a unit shares at least
t / (2 - t) * n of them. So all but that many less one of a template's bigrams
can be left out, and a text with none of the rest holds no unit of it.

At scale: one map-only pass of DataFrame functions; no shuffle. Only texts that
pass the bigram test are cut into units.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, functions as F

# Notices and short licences, by identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
                     "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
                     "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                     "documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
            "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
            "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
            "DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
)

OTHER_SIGNS = r"[^\p{L}\p{N}\n]+"


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def bounds(n: int, t: float) -> tuple[int, int, int]:
    """Least and most bigrams of a unit for a template of n, and least shared."""
    return (math.ceil(t / (2 - t) * n - 1e-9), math.floor((2 - t) / t * n + 1e-9), math.ceil(t / (2 - t) * n - 1e-9))


def bigrams(normal: Column) -> Column:
    """The distinct word bigrams of a normalised unit."""
    words = F.filter(F.split(normal, r"[ \n]+"), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(F.array_append(words, F.lit(None)), F.lit(2), F.size(words)),
                       lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.filter(F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")),
                                     lambda b: b.isNotNull()))


def find_licences(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.9,
                  text_column: str = "text", out: str = "licence_units") -> DataFrame:
    """``docs`` and an array ``out`` of (licence, unit, place, dice): which unit
    (``text``, ``paragraph`` or ``line``, numbered from 0) is of which licence.
    A unit of two templates of one licence is listed once, with the higher value;
    a unit that reaches two licences is listed for both.

    Null, empty and one-word texts have none. Every row keeps its own result,
    repeated rows and null ids too; an empty table stays empty. A column of the
    name ``out`` is replaced; all others stay as they are.
    """
    t = threshold
    rows, any_of = [], []
    for name, text in templates:
        own = template_bigrams(text)
        low, high, shared = bounds(len(own), t)
        rows.append({"licence": name, "b": own, "n": len(own), "low": low, "high": high})
        any_of += sorted(own, key=len)[::-1][:len(own) - shared + 1]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<licence:string,b:array<string>,n:int,low:int,high:int>>")
    some = F.from_json(F.lit(json.dumps(sorted(set(any_of)))), "array<string>")
    low, high = min(r["low"] for r in rows), max(r["high"] for r in rows)

    def matches(unit: Column) -> Column:
        """Licences of one (unit, place, b) struct."""
        size = F.size(unit["b"])
        fits = F.filter(table, lambda r: size.between(r["low"], r["high"]))
        scored = F.transform(fits, lambda r: F.struct(
            r["licence"].alias("licence"), unit["unit"].alias("unit"), unit["place"].alias("place"),
            (2 * F.size(F.array_intersect(unit["b"], r["b"])) / (size + r["n"])).alias("dice")))
        return F.filter(scored, lambda s: s["dice"] >= t - 1e-9)

    def units(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("unit"), i.alias("place"), bigrams(p).alias("b")))

    normal = F.regexp_replace(F.lower(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))), OTHER_SIGNS, " ")
    kept = docs.withColumn("_normal", normal).withColumn("_hit", F.arrays_overlap(bigrams(F.col("_normal")), some))
    every = F.concat(units("text", F.array("_normal")), units("paragraph", F.split("_normal", r"\n *\n[ \n]*")),
                     units("line", F.split("_normal", r"\n")))
    in_size = F.filter(every, lambda u: F.size(u["b"]).between(low, high))
    found = F.flatten(F.transform(in_size, matches))
    # Sorted, so of equal licence, unit and place the highest value comes last.
    found = F.array_sort(found)
    last = F.filter(F.transform(found, lambda s, i: F.struct(s.alias("s"), F.get(found, i + 1).alias("next"))),
                    lambda p: p["next"].isNull() | (p["next"]["licence"] != p["s"]["licence"])
                    | (p["next"]["unit"] != p["s"]["unit"]) | (p["next"]["place"] != p["s"]["place"]))
    empty = F.from_json(F.lit("[]"), "array<struct<licence:string,unit:string,place:int,dice:double>>")
    return (kept.withColumn(out, F.when(F.col("_hit"), F.transform(last, lambda p: p["s"])).otherwise(empty))
            .drop("_normal", "_hit"))
