"""License scans: passages against license templates by the Dice coefficient of word bigrams. DataFrame functions only."""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

# Short notices by which works name their license, notices of files, and license texts, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "LGPL-3.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]

LEAST = 0.8
#: Words that say little about a passage.
COMMON = frozenset("a an and any be by for from in is of on or that the this to under with work you".split())
#: Templates that a scan takes at most; each is tried on the passages within its size bounds.
MOST_TEMPLATES = 1000


def words_of(text: str) -> list[str]:
    """Words of the normalised text: lower case, all but ASCII letters and digits as one space."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip().split()


def bigrams(text: str) -> set[str]:
    """Pairs of neighbouring words."""
    w = words_of(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def triggers(grams: set[str], least: float) -> list[str]:
    """Words of which every passage within the threshold must hold one.

    A coefficient of ``least`` needs least / (2 - least) of a template's bigrams.
    The longest words, common ones last, are taken until the bigrams with one of them are
    too many to be missed: a passage with none of these words lacks all those bigrams.
    """
    may_miss = len(grams) - ceil(least / (2 - least) * len(grams) - 1e-9)
    out: list[str] = []
    covered: set[str] = set()
    for w in sorted({x for g in grams for x in g.split()}, key=lambda x: (x in COMMON, -len(x), x)):
        if len(covered) > may_miss:
            break
        mine = {g for g in grams if w in g.split()}
        if mine - covered:
            covered |= mine
            out.append(w)
    return out


def anchors(templates: list[tuple[str, str]], least: float) -> dict[str, list[tuple[int, int]]]:
    """For each trigger word the templates and places in them at which it stands: (template, words before it)."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, body) in enumerate(templates):
        own = set(triggers(bigrams(body), least))
        for before, w in enumerate(words_of(body)):
            if w in own:
                out.setdefault(w, []).append((t, before))
    return out


def _words(unit: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """``(id, license, dice, passages, first_line)``: licenses whose template some passage of a document resembles.

    Passages are a text's lines, its paragraphs (parted by blank lines), the whole
    text and, wherever a template's trigger word stands, as many words as the
    template has from where it would begin: a notice within a longer line or
    paragraph, wrapped in a comment or followed by code. Normalised are both: lower case, everything but ASCII letters and
    digits a space. The coefficient is 2 |A and B| / (|A| + |B|) of the sets of
    word bigrams. Before any bigram is made, texts and passages are dropped that
    hold none of the words a match must hold, and a passage is tried only on
    templates whose size is within least / (2 - least) of its number of words; neither loses a match.
    Templates are a literal of at most ``MOST_TEMPLATES``; there is no join and,
    as a document's best is found in its own row, no shuffle.

    A row for each document row and license: the best coefficient, how many
    passages reach ``least``, and the first line that does by itself (-1 if only
    longer passages do). Null and empty texts and texts of one word give no row.
    Rows that repeat give repeated results. Other columns aren't read.
    """
    templates = TEMPLATES if templates is None else templates
    templates = [(name, t) for name, t in templates if bigrams(t)]
    known = [(name, sorted(bigrams(t))) for name, t in templates]
    if len(known) > MOST_TEMPLATES:
        raise ValueError(f"{len(known)} templates; a scan takes {MOST_TEMPLATES}")
    id_type = docs.schema[id_col].dataType.simpleString()
    if not known:
        return docs.sparkSession.createDataFrame([], f"{id_col} {id_type}, license string, dice double, passages long, first_line int")
    ratio = least / (2 - least)
    some = "(?i)(?<![a-z0-9])(?:" + "|".join(sorted({w for _, g in known for w in triggers(set(g), least)})) + ")(?![a-z0-9])"
    literal = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(g)).alias("size"), F.array(*map(F.lit, g)).alias("grams")) for name, g in known])
    smallest, largest = min(len(g) for _, g in known) * ratio, max(len(g) for _, g in known) / ratio

    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(text.rlike(some))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("unit")))
    longer = F.concat(F.split(text, r"\n\s*\n"), F.array(text))
    longer = F.transform(F.filter(F.array_distinct(longer), lambda x: x.contains("\n")), lambda x: F.struct(F.lit(-1).alias("line"), x.alias("unit")))
    units = F.filter(F.concat(lines, longer), lambda u: u["unit"].rlike(some))
    words = F.transform(units, lambda u: F.struct(u["line"].alias("line"), _words(u["unit"]).alias("w")))
    # distinct bigrams are at most the words but one, and repeats could bring a longer passage within the bounds
    words = F.filter(words, lambda u: F.size(u["w"]) - 1 >= smallest)
    grams = F.transform(words, lambda u: F.struct(u["line"].alias("line"), F.array_distinct(F.zip_with(F.slice(u["w"], F.lit(1), F.size(u["w"]) - 1), F.slice(u["w"], F.lit(2), F.size(u["w"]) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).alias("g")))
    grams = F.filter(grams, lambda u: (F.size(u["g"]) >= smallest) & (F.size(u["g"]) <= largest))
    places = anchors(templates, least)
    at_word = F.create_map(*[x for w, ts in sorted(places.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(n).alias("before")) for t, n in ts]))])
    lengths = F.array(*[F.lit(len(words_of(t))) for _, t in templates])
    listed = F.array(*map(F.lit, sorted(places)))
    rows = rows.select("id", grams.alias("units"), _words(text).alias("w")).withColumns({"templates": literal, "lengths": lengths, "at_word": at_word})
    hits = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("i"))), lambda h: F.array_contains(listed, h["word"]))
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.col("at_word")[h["word"]], lambda a: F.struct(a["t"].alias("t"), F.greatest(h["i"] - a["before"], F.lit(0)).alias("start"))))))
    rows = rows.withColumn("starts", starts).where("size(units) > 0 or size(starts) > 0")

    def window(s: Column) -> Column:
        """Dice of the words from a start on with the template that would begin there."""
        t = F.get(F.col("templates"), s["t"])
        v = F.slice(F.col("w"), s["start"] + 1, F.get(F.col("lengths"), s["t"]))
        g = F.when(F.size(v) > 1, F.array_distinct(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))).otherwise(F.array().cast("array<string>"))
        dice = F.get(F.transform(F.array(g), lambda g: F.lit(2.0) * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["size"])), F.lit(0))
        return F.struct(t["license"].alias("license"), F.lit(-1).alias("line"), dice.alias("dice"))

    def tried(u: Column) -> Column:
        near = F.filter(F.col("templates"), lambda t: (F.size(u["g"]) >= t["size"] * ratio) & (t["size"] >= F.size(u["g"]) * ratio))
        scored = F.transform(near, lambda t: F.struct(t["license"].alias("license"), u["line"].alias("line"), (F.lit(2.0) * F.size(F.array_intersect(u["g"], t["grams"])) / (F.size(u["g"]) + t["size"])).alias("dice")))
        return F.filter(scored, lambda s: s["dice"] >= least)

    windows = F.filter(F.transform("starts", window), lambda s: s["dice"] >= least)
    rows = rows.select("id", F.concat(F.flatten(F.transform("units", tried)), windows).alias("hits")).where(F.size("hits") > 0)
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"])))
    out = rows.select("id", "hits", F.explode(names).alias("license")).withColumn("own", F.filter("hits", lambda h: h["license"] == F.col("license")))
    by_itself = F.filter(F.col("own"), lambda h: h["line"] >= 0)
    return out.select(
        F.col("id").alias(id_col),
        "license",
        F.array_max(F.transform("own", lambda h: h["dice"])).alias("dice"),
        F.size(F.array_distinct(F.transform("own", lambda h: h["line"]))).cast("long").alias("passages"),
        F.coalesce(F.array_min(F.transform(by_itself, lambda h: h["line"])), F.lit(-1)).alias("first_line"),
    )
