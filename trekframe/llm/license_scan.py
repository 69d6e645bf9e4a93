"""Licence notices by Dice similarity of word bigrams.

A text's lines, its paragraphs and the whole of it are compared with licence
templates after normalisation (lower case, everything but a-z and 0-9 as one
space). Dice of two bigram sets A and B is 2|A and B| / (|A| + |B|). To reach a
threshold t, |A| must lie between |B| t/(2-t) and |B| (2-t)/t: that prunes
templates by size before any overlap is computed. It also needs an overlap of
at least |B| t/(2-t) bigrams; each template therefore has a few anchor words of
which any such segment holds one, and segments without any are passed over.
Both bounds are exact: no pair that reaches the threshold is lost.

Where no such segment reaches the threshold, notices may still stand inside a
longer line or span paragraphs. Then windows of consecutive words are compared,
wherever lines end: the best window starts and ends with a bigram of the
template (else it would be better without its ends), so only those are tried,
up to the size bound, for templates of which the whole text holds enough
bigrams.

Licences of one family differ in a word or a number, which Dice hardly feels. So
a segment must tell the same variant as the template: the words of ``VARIANTS``
that it has are the template's, and a template that names a version needs that
version's bigrams (``needs``). A notice of a version or variant that no template
has gets no name rather than a relative's.

All of it runs inside the row, with DataFrame functions alone.

Defined cases: null and empty texts match nothing (name null, score 0); equal
scores go to the template that sorts first; repeated rows get equal results;
very long texts are scanned whole; an empty table gives an empty result; extra
columns are unread.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trekframe.llm.common import bind

THRESHOLD = 0.8

# Names and wording of widely used licence notices.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD line": "Released under the BSD License.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0 line": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0 line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0 line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-3.0 line": "Licensed under CC BY 3.0.",
    "CC-BY-SA-3.0 line": "Licensed under CC BY-SA 3.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 sentence": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 sentence": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0 sentence": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0 sentence": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0 sentence": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-3.0 sentence": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-SA-3.0 sentence": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC0-1.0 sentence": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "AGPL-3.0 sentence": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "GPL-1.0 sentence": "This work is licensed under the GNU General Public License, version 1.",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0 sentence": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 sentence": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-2.1 sentence": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0 sentence": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT line": "Released under the MIT License.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Zlib notice": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Words that tell licences of a family apart.
VARIANTS = frozenset("affero endorse lesser nc nd noderivatives noderivs noncommercial sa sharealike".split())

#: Words of most English texts: anchors only where nothing else will do.
COMMON = frozenset("a all and any are as at by for from in is it may no of on or that the this to under with you your".split())


def needs(name: str, grams: list[str]) -> list[str]:
    """Bigrams of a template of which one tells its version: a word with the major number, or the major with the minor one if that isn't 0. None if its name has no version."""
    m = re.search(r"-([0-9]+)\.([0-9]+)(?: |$)", name)
    if not m:
        return []
    return [g for g in grams if (g == f"{m[1]} {m[2]}" if m[2] != "0" else re.fullmatch(rf"[a-z]+[0-9]? {m[1]}", g))]


def _words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a text, normalised."""
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def variants(grams: list[str]) -> list[str]:
    return sorted({w for g in grams for w in g.split()} & VARIANTS)


def bounds(n: int, t: float) -> tuple[float, float]:
    """Sizes of the other set with which Dice can reach t."""
    return n * t / (2 - t), n * (2 - t) / t


def anchors(grams: list[str], t: float) -> set[str]:
    """Words of which every set of bigrams that reaches Dice t with grams holds one: without them too few bigrams are left."""
    left, chosen = set(grams), set()
    rank = Counter(w for g in grams for w in g.split())
    for word in sorted(rank, key=lambda w: (w in COMMON, -len(w), w)):
        if len(left) < bounds(len(grams), t)[0]:
            break
        chosen.add(word)
        left = {g for g in left if word not in g.split()}
    return chosen


def _normalised(text: Column) -> Column:
    """Normalised, with line ends kept."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9\n]+", " ")


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, license (best template at or above the threshold, or null), dice (its score, else 0), n_segments (segments with an anchor word) and licenses (all such templates' names in order, comma-joined)."""
    table = {k: bigrams(v) for k, v in sorted((templates or TEMPLATES).items())}
    lengths = {k: len(_words(v)) - 1 for k, v in (templates or TEMPLATES).items()}
    least = min(bounds(len(g), threshold)[0] for g in table.values())
    most = max(bounds(len(g), threshold)[1] for g in table.values())
    pattern = r"(?:^|[ \n])(?:" + "|".join(sorted(set().union(*[anchors(g, threshold) for g in table.values()]))) + r")(?:$|[ \n])"
    # One literal, folded once: thousands of literals would make the plan slow to build.
    rows = [{"name": k, "grams": g, "length": lengths[k], "needs": needs(k, g), "variants": variants(g)} for k, g in table.items()]
    known = F.from_json(F.lit(json.dumps(rows)), "array<struct<name:string,grams:array<string>,length:int,needs:array<string>,variants:array<string>>>")
    telling = F.array(*map(F.lit, sorted(VARIANTS)))

    def tells(grams: Column, k: Column) -> Column:
        """Whether a segment's bigrams tell the template's version and variant."""
        mine = F.array_intersect(F.flatten(F.transform(grams, lambda g: F.split(g, " "))), telling)
        version = (F.size(k["needs"]) == 0) | F.arrays_overlap(grams, k["needs"])
        return version & (F.size(mine) == F.size(k["variants"])) & (F.size(F.array_except(mine, k["variants"])) == 0)

    def segments(norm: Column) -> Column:
        lines = F.split(norm, "\n", -1)
        paragraphs = F.transform(F.split(norm, "\n *\n", -1), lambda p: F.translate(p, "\n", " "))
        parts = F.array_distinct(F.transform(F.concat(lines, paragraphs, F.array(F.translate(norm, "\n", " "))), lambda s: F.regexp_replace(F.trim(s), " +", " ")))
        return F.filter(parts, lambda s: s.rlike(pattern))

    def grams_of(segment: Column) -> Column:
        return bind(F.split(segment, " "), lambda w: F.when(F.size(w) - 1 >= least, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", w[i], w[i + 1])))).otherwise(F.array().cast("array<string>")))

    def best(grams: Column) -> Column:
        n = F.size(grams).cast("double")
        fits = F.filter(known, lambda k: (F.size(k["grams"]) * (threshold / (2 - threshold)) <= n) & (n <= F.size(k["grams"]) * ((2 - threshold) / threshold)))
        scored = F.transform(fits, lambda k: F.struct((2.0 * F.size(F.array_intersect(grams, k["grams"])) / (n + F.size(k["grams"]))).alias("dice"), k["name"].alias("name"), k.alias("k")))
        return F.transform(F.filter(scored, lambda x: (x["dice"] >= threshold) & tells(grams, x["k"])), lambda x: F.struct(x["dice"].alias("dice"), x["name"].alias("name")))

    def inside(words: Column) -> Column:
        """The best window of the words for each template that enough of their bigrams belong to."""
        grams = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", words[i], words[i + 1]))

        def of_template(grams: Column, k: Column) -> Column:
            size = F.size(k["grams"])
            enough = size * (threshold / (2 - threshold))
            longest = F.greatest(F.floor(size * ((2 - threshold) / threshold)), k["length"]).cast("int")

            def from_start(at: Column, ends: Column) -> Column:
                def until(end: Column) -> Column:
                    return bind(F.array_distinct(F.slice(grams, at + 1, end - at + 1)), lambda w: bind(2.0 * F.size(F.array_intersect(w, k["grams"])) / (F.size(w) + size), lambda dice: F.when((dice >= threshold) & tells(w, k), dice)))

                return F.when(F.size(F.array_distinct(F.transform(ends, lambda e: grams[e]))) >= enough, F.array_max(F.transform(ends, until)))

            def over(marked: Column) -> Column:
                # positions ascend, so a start's ends are among the next ones: no more than the longest window has bigrams
                return F.array_max(F.transform(marked, lambda at, i: bind(F.filter(F.slice(marked, i + 1, longest), lambda e: e < at + longest), lambda ends: from_start(at, ends))))

            places = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(k["grams"], g), i)), lambda i: i.isNotNull())
            return F.struct(F.coalesce(bind(places, over), F.lit(0.0)).alias("dice"), k["name"].alias("name"))

        def over_templates(grams: Column) -> Column:
            held = bind(F.array_distinct(grams), lambda d: F.filter(known, lambda k: F.size(F.array_intersect(d, k["grams"])) >= F.size(k["grams"]) * (threshold / (2 - threshold))))
            return F.transform(held, lambda k: of_template(grams, k))

        return F.when(F.size(words) - 1 >= least, bind(grams, over_templates)).otherwise(F.array().cast("array<struct<dice:double,name:string>>"))

    def scan(parts: Column) -> Column:
        sized = F.filter(F.transform(parts, grams_of), lambda g: (F.size(g) >= least) & (F.size(g) <= most))
        return first(F.flatten(F.transform(sized, lambda g: bind(g, best))))

    def first(scored: Column) -> Column:
        """The best hit, and the names of all."""
        order = lambda a, b: F.when(a["dice"] != b["dice"], F.when(a["dice"] > b["dice"], -1).otherwise(1)).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
        names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["name"]))), ",")
        return bind(F.filter(scored, lambda x: x["dice"] >= threshold), lambda hits: F.when(F.size(hits) > 0, F.struct(F.array_sort(hits, order)[0].alias("best"), names(hits).alias("all"))))

    norm = _normalised(F.coalesce(F.col(text_col), F.lit("")))
    parts = bind(norm, lambda t: F.when(t.rlike(pattern), segments(t)).otherwise(F.array().cast("array<string>")))

    def hit(p: Column) -> Column:
        words = F.array_remove(F.split(norm, "[ \n]+"), "")
        return bind(scan(p), lambda h: F.when(h.isNotNull(), h).otherwise(bind(words, lambda w: first(inside(w)))))

    rows = docs.select(F.col(id_col).alias("doc_id"), bind(parts, lambda p: F.struct(F.size(p).alias("n"), F.when(F.size(p) > 0, hit(p)).alias("hit"))).alias("s"))
    return rows.select("doc_id", F.col("s.hit.best.name").alias("license"), F.coalesce(F.col("s.hit.best.dice"), F.lit(0.0)).alias("dice"), F.col("s.n").cast("long").alias("n_segments"), F.coalesce(F.col("s.hit.all"), F.lit("")).alias("licenses"))
