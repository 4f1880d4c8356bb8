"""Licence scans: Dice coefficient over word bigrams against licence templates, with DataFrame functions alone.

Units are each line of a document, and the whole document if it has several lines. Text is normalised to lower-case ASCII words. A template can reach
the threshold t only if the unit's number of bigrams lies within [n * t / (2 - t), n * (2 - t) / t], so other templates are
pruned by size before any set is built, and units outside all bounds never build theirs. Before all this, texts go that lack words which every text
near some template has (anchors). Templates are a fixed list, so everything happens in two passes over the texts, without a shuffle.

A template may also lie over several lines of a longer document, or within a longer line. passages() finds it wherever it is: in the words of the whole document,
it takes the runs that start and end on a bigram of the template (any other run is bettered by cutting its ends off) and have at most (2 - t) / t times the template's words.
Of runs of one template that overlap the one with the greatest Dice stays, of those of several templates the one that shares most bigrams. A row is given
for each that no unit has told of: its line is the one on which it starts.

Defined cases: null and empty texts match nothing; a unit of one word has no bigram and matches nothing; of templates with equal Dice the first by name wins; repeated rows
give repeated results; very long texts are scanned whole, in one task each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwright.llm.common import ascii_lower, once

THRESHOLD = 0.8
#: Public licence notices and short licence texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-3-clause": "Licensed under the BSD 3-Clause License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def plain_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def plain_bigrams(text: str) -> list[str]:
    words = plain_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(n: int, threshold: float) -> tuple[float, float]:
    """Sizes that a set must have to reach the threshold against one of size n."""
    return n * threshold / (2 - threshold), n * (2 - threshold) / threshold


def bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Units and passages that reach the threshold: doc_id, line (from 0; -1: the whole text), license, dice."""
    return units(docs, templates, threshold).unionByName(passages(docs, templates, threshold))


def units(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The best template of each line and of each whole text."""
    sets = {name: plain_bigrams(text) for name, text in sorted(templates.items())}
    lows, highs = zip(*(bounds(len(x), threshold) for x in sets.values()))
    vocabulary = F.array(*[F.lit(x) for x in sorted(set().union(*sets.values()))])
    # Runs of other characters part words, and so does either end of a unit.
    clean = F.regexp_replace(ascii_lower(F.col("text")), "[^a-z0-9\\n]+", " ")
    texts = once(likely(docs, sets, threshold), "clean", clean).select("doc_id", "clean")
    texts = once(texts, "lines", F.transform(F.split("clean", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("unit"))))
    whole = F.array(F.struct(F.lit(-1).alias("line"), F.translate("clean", "\n", " ").alias("unit")))
    units = texts.select("doc_id", F.inline(F.when(F.size("lines") > 1, F.concat("lines", whole)).otherwise(F.col("lines"))))
    # A unit has at most words - 1 distinct bigrams, and at least distinct words - 1: both bounds prune before bigrams are built.
    units = units.filter(F.regexp_count("unit", F.lit("[a-z0-9]+")) - 1 >= min(lows))
    units = once(units, "words", F.filter(F.split(F.btrim("unit"), " +"), lambda w: w != "")).select("doc_id", "line", "words")
    units = units.filter(F.size(F.array_distinct("words")) - 1 <= max(highs))
    units = once(units, "grams", bigrams(F.col("words"))).select("doc_id", "line", "grams")
    units = units.filter(F.size("grams").between(min(lows), max(highs)))
    units = once(units, "shared", F.array_intersect("grams", vocabulary))
    units = units.filter(F.size("shared") > 0).select("doc_id", "line", "shared", F.size("grams").alias("n"))

    def score(name: str, own: list[str]) -> Column:
        low, high = bounds(len(own), threshold)
        common = F.size(F.array_intersect("shared", F.array(*map(F.lit, own))))
        dice = F.lit(2.0) * common / (F.col("n") + len(own))
        return F.when(F.col("n").between(low, high), F.struct((-dice).alias("rest"), F.lit(name).alias("license")))

    best = F.array_min(F.filter(F.array(*[score(*x) for x in sets.items()]), lambda s: s.isNotNull() & (s["rest"] <= -threshold)))
    found = once(units, "best", best).filter("best is not null")
    return found.select("doc_id", "line", F.col("best.license").alias("license"), (-F.col("best.rest")).alias("dice"))


def anchors(grams: list[str], threshold: float) -> list[list[str]]:
    """Sets of words: a text that shares enough of these bigrams has a word of each set.

    It can spare only so many bigrams, so it has one of any greater number: of those of a word that is in more, and of disjoint groups, taken by
    long words in many bigrams, and again by those in most bigrams.
    """
    spare = len(grams) - math.ceil(bounds(len(grams), threshold)[0] - 1e-9)
    held = {w: {g for g in grams if w in g.split(" ")} for w in sorted({w for g in grams for w in g.split(" ")}, reverse=True)}
    out = [[w] for w in held if len(held[w]) > spare]
    for order in (lambda w: -len(held[w]) * len(w) * (len(w) > 4), lambda w: (-len(held[w]), -len(w))):
        left, group, taken = set(grams), [], 0
        for word in sorted(held, key=order):
            own = held[word] & left
            if own:
                left, group, taken = left - own, [*group, word], taken + len(own)
            if taken > spare:
                out, group, taken = [*out, group], [], 0
    return sorted(out, key=lambda x: (min(map(len, x)) < 4, len(x)))


def may_hold(grams: list[str], threshold: float) -> Column:
    """Whether a text, given in lower case as column low, has what anchors() asks for. Words are looked for as parts of others first, which is cheap; short ones then by themselves."""
    part = lambda w: F.contains("low", w if isinstance(w, Column) else F.lit(w))
    whole = lambda w: part(w) & F.rlike("low", F.lit(f"(?<![a-z0-9]){w}(?![a-z0-9])"))
    each, short = anchors(grams, threshold), lambda group: min(map(len, group)) < 4
    tests = [[part(w) for w in group] for group in each] + [[whole(w) if len(w) < 4 else part(w) for w in group] for group in each if short(group)]
    anchored = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, words) for words in tests])
    # Then as many bigrams as are shared at least have both their words in the text.
    words = F.filter(F.array(*[F.lit(w) for w in sorted({w for g in grams for w in g.split(" ")})]), part)
    pairs = F.array(*[F.array(*map(F.lit, g.split(" "))) for g in grams])
    both = let(words, lambda held: F.size(F.filter(pairs, lambda g: F.array_contains(held, g[0]) & F.array_contains(held, g[1]))))
    return anchored & (both >= math.ceil(bounds(len(grams), threshold)[0] - 1e-9))


def likely(docs: DataFrame, sets: dict[str, list[str]], threshold: float) -> DataFrame:
    """(doc_id, text) of the texts that can hold some template, whole or in part: most have some template's anchors nowhere, and go unread by what follows."""
    texts = once(docs.select("doc_id", "text").filter(F.col("text") != ""), "low", F.lower("text"))
    return texts.filter(reduce(lambda a, b: a | b, [may_hold(own, threshold) for own in sets.values() if own])).select("doc_id", "text")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, within a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def apart(runs: Column, kind: str) -> Column:
    """Of runs in order of merit, those that overlap no better one."""
    free = lambda kept, x: ~F.exists(kept, lambda y: (y["first"] <= x["last"]) & (x["first"] <= y["last"]))
    return F.aggregate(runs, F.array().cast(f"array<{kind}>"), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def passages(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Runs of words, wherever they lie, that reach the threshold and that units() has not told of."""
    sets = {name: plain_bigrams(text) for name, text in sorted(templates.items())}
    vocabulary = F.array(*[F.lit(x) for x in sorted(set().union(*sets.values()))])
    known = F.array(*[
        F.struct(
            F.lit(name).alias("license"),
            F.array(*map(F.lit, own)).alias("own"),
            F.lit(math.ceil(bounds(len(own), threshold)[0] - 1e-9)).alias("least"),
            F.lit(int((len(plain_words(templates[name])) - 1) * (2 - threshold) / threshold + 1e-9)).alias("reach"),
        )
        for name, own in sets.items() if own
    ])

    # Of the texts that have a template's anchors most share too few bigrams with it.
    texts = likely(docs, sets, threshold)
    clean = F.regexp_replace(ascii_lower(F.col("text")), "[^a-z0-9\\n]+", " ")
    split = F.transform(F.split(clean, "\n", -1), lambda x: F.filter(F.split(x, " "), lambda w: w != ""))
    texts = once(texts, "lines", split).select("doc_id", "lines")
    texts = once(texts, "words", F.flatten("lines")).filter(F.size("words") > 1)
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))
    texts = once(texts, "grams", pairs).select("doc_id", "lines", "grams")
    texts = once(texts, "shared", F.array_intersect("grams", vocabulary)).filter(F.size("shared") > 0)
    texts = once(texts, "known", F.filter(known, lambda t: F.size(F.array_intersect("shared", t["own"])) >= t["least"])).filter(F.size("known") > 0)
    texts = once(texts, "line_of", F.flatten(F.transform("lines", lambda x, i: F.transform(x, lambda _: i))))
    places = F.filter(F.transform("grams", lambda g, i: F.struct(i.alias("i"), g.alias("g"))), lambda x: F.array_contains("shared", x["g"]))
    texts = once(texts, "places", places)

    def run(t: Column, near: Column, end: Column, j: Column) -> Column:
        """The run from the first of these hits to the one at j."""
        first = near[0]["i"]
        common = F.size(F.array_distinct(F.transform(F.slice(near, 1, j + 1), lambda h: h["g"])))
        n = F.size(F.array_distinct(F.slice("grams", first + 1, end["i"] - first + 1)))
        return F.struct((-(F.lit(2.0) * common / (n + F.size(t["own"])))).alias("rest"), (-common).alias("common"), first.alias("first"), end["i"].alias("last"), t["license"].alias("license"))

    def best_run(t: Column, near: Column) -> Column:
        """The best run from the first of these hits; none if too few are left."""
        enough = F.size(F.array_distinct(F.transform(near, lambda h: h["g"]))) >= t["least"]
        ends = F.filter(F.transform(near, lambda e, j: F.when(j + 1 >= t["least"], run(t, near, e, j))), lambda r: r.isNotNull() & (r["rest"] <= -threshold))
        return F.when(enough, F.array_min(ends))

    def runs(t: Column, hits: Column) -> Column:
        from_each = F.transform(hits, lambda h, k: let(F.filter(F.slice(hits, k + 1, t["reach"]), lambda x: x["i"] < h["i"] + t["reach"]), lambda near: best_run(t, near)))
        return apart(F.array_sort(F.filter(from_each, lambda r: r.isNotNull())), "struct<rest:double,common:int,first:int,last:int,license:string>")

    each = F.transform("known", lambda t: let(F.filter("places", lambda x: F.array_contains(t["own"], x["g"])), lambda hits: runs(t, hits)))
    texts = once(texts, "runs", F.flatten(each)).filter(F.size("runs") > 0)

    def told(grams: Column) -> Column:
        """The template that units() gives for a unit of these distinct bigrams, or null."""
        scores = lambda g: F.transform("known", lambda t: F.struct((-(F.lit(2.0) * F.size(F.array_intersect(g, t["own"])) / (F.size(g) + F.size(t["own"])))).alias("rest"), t["license"].alias("license")))
        return F.array_min(F.filter(let(grams, scores), lambda s: s["rest"] <= -threshold))["license"]

    # A run of bigrams ends with the second word of the last one.
    spans = F.transform("runs", lambda r: F.struct(F.get("line_of", r["first"]).alias("line"), F.get("line_of", r["last"] + 1).alias("end"), r.alias("r")))
    texts = once(texts, "spans", spans)
    touched = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["line"], s["end"]))))
    texts = once(texts, "lines_told", F.transform(touched, lambda i: F.struct(i.alias("line"), let(F.get("lines", i), lambda words: told(bigrams(words))).alias("license"))))
    texts = once(texts, "text_told", F.when(F.size("lines") > 1, told(F.array_distinct("grams"))))
    known_of = lambda s: F.coalesce(F.col("text_told") == s["r"]["license"], F.lit(False)) | F.exists(
        "lines_told", lambda x: x["line"].between(s["line"], s["end"]) & F.coalesce(x["license"] == s["r"]["license"], F.lit(False))
    )
    ranked = F.transform("spans", lambda s: F.struct((~known_of(s)).alias("new"), s["r"]["common"].alias("common"), s["r"]["rest"].alias("rest"), s["r"]["first"].alias("first"), s["r"]["last"].alias("last"), s["r"]["license"].alias("license"), s["line"].alias("line")))
    kept = apart(F.array_sort(ranked), "struct<new:boolean,common:int,rest:double,first:int,last:int,license:string,line:int>")
    found = texts.select("doc_id", F.explode(F.filter(kept, lambda x: x["new"])).alias("p"))
    return found.select("doc_id", F.col("p.line").alias("line"), F.col("p.license").alias("license"), (-F.col("p.rest")).alias("dice"))
