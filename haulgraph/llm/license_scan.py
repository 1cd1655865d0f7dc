"""License scan in SQL functions alone: windows of a text against templates, then inheritance along directories.

A template of n words is compared with every window of n words of a text, an eighth of n apart, whatever lines or comment
marks part them, so a header wrapped over lines, a sentence inside a paragraph and a whole licence text are all found. A
window and a template are sparse vectors of square root of term frequency by inverse document frequency (that of the
templates; a word of no template weighs as the rarest), compared by cosine. A window must hold the template's version and
just those of its family's marks (Affero, Lesser, the third clause, ShareAlike, ...) that the template holds, so no license
goes by the name of a near relative; a template under ``SHORT`` words asks for a higher score and for no denial (``not``,
``never``, ...) in the window or up to three words before. The best window of ``least`` or more names the file's own
license; equal scores go to the lesser name. A first SPDX identifier that names a known license goes before all windows,
with a score of 1.

No window can reach ``least`` unless the words that the whole text shares with the template hold ``least`` squared of the
template's squared weight, so texts that do not share as much are skipped exactly. All this is one projection over the
rows, without a shuffle, written once; the templates are one literal in it.

A file is a licence file if it names a license and is called as one (LICENSE, COPYING, ...), or if a whole license, not a
header, holds two thirds of its words. A directory has the license that most of its licence files name (ties: the lesser name); a file
without its own takes that of the nearest ancestor directory that has one. Inheritance joins distinct directories with
their ancestors, then files by directory, so no join has more rows than there are files or directories times their depth.

Defined results: null and empty texts have no license of their own; texts of any length are read whole; a null path has no
directory; a path without ``/`` is in the root ``''``; a path that ends
in ``/`` is a file without a name in the directory before that slash; repeated rows repeat; the input's other columns are dropped, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# How licenses are named in headers, and the texts of short licenses or the beginnings of long ones.
TEMPLATES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, all copyright and related rights to this work are waived, CC0 public domain dedication."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-2.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Library General Public License for more details.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
# Words that part licenses of one family (by a part of the name); a window holds just those that its template does.
MARKS = {"GPL": ["affero", "lesser"], "BSD-": ["neither"], "CC-BY": ["nc", "nd", "noncommercial", "noderivatives", "sa", "sharealike"]}
# Words that deny what a short template says, in a window or up to three words before.
DENIALS = "cannot isn never no nor not without".split()
# Fixed value: how an SPDX line names its (first) license.
SPDX = "spdx-license-identifier:[ \\t]*[(]?([a-z0-9.+-]*[a-z0-9])"
SPDX_ENDING = "(-only|-or-later)$"
#: Templates that are whole licenses: a file of little else is a licence file.
WHOLE = ("BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT", "Unlicense")
# Fixed value: how licence files are called, with any ending.
LICENCE_NAMES = "^(licen[cs]e|copying|unlicense|copyright|notice)([._-].*)?$"
# Words of any prose, the last by which a text is told to hold a template.
COMMON = "a all an and any are as at be but by can do for from has have if in is it may no not of on one or out such that the this to use was we will with you".split()
SHORT, SHORT_LEAST, BEFORE = 20, 0.75, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def templates(texts: dict[str, list[str]], least: float) -> tuple[dict[str, float], float, list[dict]]:
    """Inverse document frequencies, that of an unknown word, and each template's size, step, least score, words that a
    window must and must not hold, and unit vector."""
    words = [(k, re.findall("[a-z0-9]+", x.lower())) for k, xs in sorted(texts.items()) for x in xs]
    df = {w: sum(w in x for _, x in words) for _, x in words for w in x}
    idf = {w: round(math.log((1 + len(words)) / (1 + n)) + 1, 6) for w, n in sorted(df.items())}
    rare = round(math.log(1 + len(words)) + 1, 6)
    out = []
    for k, x in words:
        v = {w: math.sqrt(x.count(w)) * idf[w] for w in sorted(set(x))}
        norm = math.sqrt(sum(y * y for y in v.values()))
        short = len(x) < SHORT
        marks = [w for part, some in MARKS.items() if part in k for w in some]
        version = re.findall("-([0-9]+)[.][0-9]", k)
        out.append({
            "name": k, "n": len(x), "step": max(1, len(x) // 8), "least": max(least, SHORT_LEAST if short else 0), "whole": k in WHOLE and not short, "before": BEFORE if short else 0,
            "must": sorted(set(marks + version) & set(x)), "bars": sorted(set(marks + (DENIALS if short else [])) - set(x)), "vector": {w: round(y / norm, 6) for w, y in v.items()},
        })
    return idf, rare, out


def keys(vector: dict[str, float], idf: dict[str, float], least: float) -> set[str]:
    """Words, the rarest first, of which a window of ``least`` or more has one: the others' squared weight is too low."""
    order = sorted(vector, key=lambda w: (w in COMMON, -idf[w], w))
    left, out = sum(x * x for x in vector.values()), set()
    for w in order:
        if left < least * least - 1e-4:
            break
        out.add(w)
        left -= vector[w] ** 2
    return out


def _literal(xs) -> F.Column:
    return F.array(*map(F.lit, xs))


def scan(files: DataFrame, texts: dict[str, list[str]] | None = None, least: float = 0.6) -> DataFrame:
    """doc_id, path, directory, own, score, licence_file of every row of ``files`` (doc_id, path, text)."""
    texts = texts or TEMPLATES
    idf, rare, forms = templates(texts, least)
    # common words first, where the search for a word's number ends soonest
    words_of_forms = sorted(set(idf).union(*(f["bars"] for f in forms)), key=lambda w: (w not in COMMON, w))
    number = {w: k + 1 for k, w in enumerate(words_of_forms)}
    # one literal: words are their numbers, vectors hold a place for every word, the first for unknown ones
    rows_of_forms = [f | {"must": [number[w] for w in f["must"]], "bars": [number[w] for w in f["bars"]], "vector": [0.0] + [f["vector"].get(w, 0.0) for w in words_of_forms]} for f in forms]
    kind = "array<struct<name:string,n:int,step:int,least:double,whole:boolean,before:int,must:array<int>,bars:array<int>,vector:array<double>>>"
    table = F.from_json(F.lit(json.dumps(rows_of_forms)), kind)
    weights = _literal([rare] + [idf.get(w, rare) for w in words_of_forms])
    telling = _literal(sorted(set().union(*(keys(f["vector"], idf, f["least"]) for f in forms))))
    numbered = lambda xs: F.transform(xs, lambda w: F.array_position(_literal(words_of_forms), w).cast("int"))
    add = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    bind = lambda x, f: F.transform(F.array(x), f)[0]

    def enough(k, held):
        """Whether the whole text shares with the form what its least score asks for."""
        return add(held, lambda i: table[k]["vector"][i] * table[k]["vector"][i]) >= table[k]["least"] * table[k]["least"] - 1e-4

    def best(k):
        """The form's best window."""
        form = table[k]

        def score(j):
            first = j * form["step"] + 1
            early = F.greatest(F.lit(1), first - form["before"])
            fits = lambda w: (F.size(F.array_intersect(w, form["must"])) == F.size(form["must"])) & ~F.arrays_overlap(F.slice("ids", early, form["n"] + first - early), form["bars"])
            dot = lambda held: add(F.array_distinct(held), lambda i: form["vector"][i] * weights[i] * F.sqrt(F.size(F.filter(held, lambda y: y == i)).cast("double")))
            cosine = lambda w: bind(F.filter(w, lambda i: form["vector"][i] > 0), lambda held: F.round(dot(held) / F.sqrt(add(w, lambda i: weights[i] * weights[i])), 5))
            return bind(F.slice("ids", first, form["n"]), lambda w: F.when(fits(w), cosine(w)).otherwise(0.0))

        last = F.greatest(F.lit(0), F.ceil((F.size("ids") - form["n"]) / form["step"]).cast("int"))
        top = F.array_max(F.transform(F.sequence(F.lit(0), last), score))
        return F.struct(top.alias("score"), form["name"].alias("name"), form["n"].alias("n"), form["whole"].alias("whole"), form["least"].alias("least"))

    lower = F.translate("text", UPPER, LOWER)
    stated = F.regexp_replace(F.regexp_extract(lower, SPDX, 1), SPDX_ENDING, "")
    names = F.create_map(*(F.lit(x) for k in sorted(texts) for x in (k.translate(str.maketrans(UPPER, LOWER)), k)))
    declared = F.when(lower.contains("spdx-license-identifier:"), F.try_element_at(names, stated))
    rows = files.select("doc_id", "path", declared.alias("declared"), F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0)).alias("words"))
    rows = rows.withColumn("shared", F.array_intersect("words", _literal(idf)))
    each = F.sequence(F.lit(0), F.lit(len(forms) - 1))
    passing = bind(numbered("shared"), lambda held: F.filter(each, lambda k: enough(k, held)))
    rows = rows.withColumn("passing", F.when(F.col("declared").isNull() & F.arrays_overlap("shared", telling), passing))
    rows = rows.withColumn("ids", F.when(F.size("passing") > 0, numbered("words")))
    rows = rows.withColumn("hits", F.when(F.col("ids").isNotNull(), F.transform("passing", best)))
    ahead = lambda a, x: (x["score"] > a["score"]) | ((x["score"] == a["score"]) & ((x["name"] < a["name"]) | ((x["name"] == a["name"]) & (x["n"] > a["n"]))))
    start = F.struct(F.lit(0.0).alias("score"), F.lit("").alias("name"), F.lit(0).alias("n"), F.lit(False).alias("whole"), F.lit(0.0).alias("least"))
    found = F.aggregate(F.filter("hits", lambda h: h["score"] >= h["least"]), start, lambda a, x: F.when(ahead(a, x), x).otherwise(a))
    rows = rows.select("doc_id", "path", "declared", F.size("words").alias("n_words"), found.alias("top"))
    seen = F.coalesce(F.col("top.n") > 0, F.lit(False))
    own = F.coalesce("declared", F.when(seen, F.col("top.name")))
    score = F.when(F.col("declared").isNotNull(), F.lit(1.0)).when(seen, F.col("top.score"))
    called = F.coalesce(F.lower(F.regexp_extract("path", "[^/]*$", 0)).rlike(LICENCE_NAMES), F.lit(False))
    alone = seen & F.col("top.whole") & (2 * F.col("n_words") <= 3 * F.col("top.n"))
    return rows.select(
        "doc_id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("directory"), own.alias("own"), score.alias("score"), F.coalesce(own.isNotNull() & (called | alone), F.lit(False)).alias("licence_file"),
    )


def licenses(files: DataFrame, texts: dict[str, list[str]] | None = None, least: float = 0.6, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, path, license, score, licence_file and origin (own, the directory it is inherited from, or null)."""
    scratch = scratch or Scratch(files.sparkSession)
    scanned = scratch.cut(scan(files, texts, least))
    named = scanned.filter(F.col("licence_file") & F.col("directory").isNotNull()).groupBy("directory", "own").agg(F.count(F.lit(1)).alias("n"))
    most = F.min(F.struct((-F.col("n")).alias("n"), "own"))["own"]
    of_directory = named.groupBy(F.col("directory").alias("ancestor")).agg(most.alias("license"))
    parts = F.split("directory", "/", -1)
    up = scanned.select("directory").filter("directory is not null").distinct()
    climbs = up.select("directory", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("depth", "ancestor")).distinct()
    given = climbs.join(of_directory, "ancestor").groupBy("directory").agg(F.max(F.struct("depth", "ancestor", "license")).alias("given")).select("directory", F.col("given.ancestor").alias("ancestor"), F.col("given.license").alias("inherited"))
    out = scanned.join(given, "directory", "left")
    return out.select("doc_id", "path", F.coalesce("own", "inherited").alias("license"), "score", "licence_file", F.when(F.col("own").isNotNull(), F.lit("own")).otherwise(F.col("ancestor")).alias("origin"))
