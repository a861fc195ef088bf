"""Licence scans: normalised text against templates by Dice coefficient over word bigrams.

Three kinds of units are scanned: every line, for the notices that stand on a line of their own, the
whole text, for documents that are a licence, and passages, for notices and licences inside a text that
are neither. A template's passages are the runs of words in which its bigrams outweigh the others; a run
ends where no passage in reach of the template could go on. A unit's word count bounds its number of bigrams;
a template whose own number is out of reach of the threshold is dropped before bigrams are compared
(2 min(a, b) / (a + b) bounds the coefficient), and units out of reach of every template are dropped
before they are cut into bigrams; so are units without any of the words that one in reach must
hold. All of it is DataFrame functions without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and short texts of public licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD 3-Clause License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}

#: Whole licences, a file each.
BODIES = Path(__file__).with_name("license_texts")

SEPARATORS = r"[^\p{L}\p{N}]+"


def all_templates() -> dict[str, tuple[str, ...]]:
    """The notices of TEMPLATES and the whole licences."""
    bodies = {f.stem: (f.read_text(encoding="utf-8"),) for f in BODIES.glob("*.txt")}
    return {name: TEMPLATES.get(name, ()) + bodies.get(name, ()) for name in TEMPLATES.keys() | bodies.keys()}


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, normalised as `normalised` does it."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def normalised(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " "))


def pairs_of(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def bigrams(words: Column) -> Column:
    return F.array_distinct(pairs_of(words))


def scan_licenses(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, unit, license, dice) for every unit that a template reaches with `least` or more.

    `unit` is the line's number from 1, 0 for the whole text of several lines, or, for a passage, the
    number of the line in which it begins, negative. Of a unit's templates the one with the highest
    coefficient counts, ties to the smaller name; of passages that overlap, the one with the highest
    coefficient, ties to the larger template. Passages of the licence that the whole text's row names are
    left out, and those of which half the words or more lie in lines that have a row. A null or empty
    text, a line of fewer than two words and an empty table give no rows; repeated rows give theirs
    each. Bigrams and rare words are looked up in tables of buckets, and passages are sought among the
    places that templates hold, so the search grows in proportion to a text's length; the passages found
    are then compared with each other, which grows with the square of their number in one text.
    """
    entries = [(name, grams) for name, texts in sorted((all_templates() if templates is None else templates).items()) for grams in map(template_bigrams, texts) if grams]
    reach = (2 - least) / least
    known = F.array(
        *(
            F.struct(F.lit(name).alias("license"), F.lit(len(g)).alias("n"), listed_words(g).alias("grams"), listed_words(anchor_words([g], least)).alias("anchors"), F.lit(shared_bigrams(g, least)).alias("shared"), F.lit(f",{k},").alias("tag"))
            for k, (name, g) in enumerate(entries)
        )
    )
    lowest = min(math.ceil(len(g) / reach) for _, g in entries)
    highest = max(math.floor(len(g) * reach) for _, g in entries)

    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    units = F.when(F.size(lines) > 1, F.concat(F.array(F.replace(text, F.lit("\n"), F.lit(" "))), lines)).otherwise(F.concat(F.array(F.lit("")), lines))
    # a step of its own: beside posexplode, `last` would be computed again for every line
    cut = docs.select("doc_id", F.concat(units, F.array(text)).alias("units")).withColumn("last", F.size("units") - 1)
    listed = cut.select("doc_id", "last", F.posexplode("units").alias("unit", "line"))
    listed = listed.filter(F.length("line") >= 2 * lowest + 1)  # a bigram takes two characters at least

    def reached(grams: Column) -> Column:
        n = F.size(grams)
        near = F.filter(known, lambda t: 2 * F.least(n, t["n"]) >= F.lit(least) * (n + t["n"]))
        scored = F.transform(near, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(grams, t["grams"])) / (n + t["n"])).alias("dice"), t["license"].alias("license")))
        best = F.aggregate(
            F.filter(scored, lambda s: s["dice"] >= least),
            F.lit(None).cast("struct<dice: double, license: string>"),
            lambda a, s: F.when(a.isNull() | (s["dice"] > a["dice"]), s).otherwise(a),
        )
        return F.when((n >= lowest) & (n <= highest), best)

    # `let` keeps each step's value from being computed again for every use of it
    anchors, anchor_buckets = word_table(anchor_words([grams for _, grams in entries], least))

    def is_anchor(word: Column) -> Column:
        return F.contains(F.get(anchors, F.pmod(F.crc32(word), F.lit(anchor_buckets)).cast("int")), F.concat(F.lit("\t"), word, F.lit("\t")))

    def best(line: Column) -> Column:
        return let(F.split(normalised(line), " "), lambda words: F.when((F.size(words) > lowest) & F.exists(words, is_anchor), let(bigrams(words), reached)))

    gain, loss, slack = (round(SCALE * x) for x in (2 - least, least, 2 - 2 * least))

    def runs(hits: Column, t: Column) -> Column:
        """The runs of places from one of `hits` to another in which a place of `hits` weighs 2 - least, any other -least.

        Between two hits the sum only falls, so hits alone are looked at. A run with fewer hits than a
        unit in reach has bigrams of the template is none. Runs are gathered in parts, as an array that
        grows is copied for each of its members.
        """
        start = F.struct(
            *(F.lit(0).alias(c) for c in ("at", "first", "last", "count", "held")), F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("peak"),
            F.array().cast(f"array<array<{RUN}>>").alias("parts"), F.array().cast(f"array<{RUN}>").alias("part"),
        )

        def gathered(s: Column) -> Column:
            more = F.concat(s["part"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"))))
            full = F.struct(F.concat(s["parts"], F.array(more)).alias("parts"), F.array().cast(f"array<{RUN}>").alias("part"))
            same = F.struct(s["parts"].alias("parts"), s["part"].alias("part"))
            return F.when(s["held"] < t["shared"], same).when(F.size(s["part"]) >= PART, full).otherwise(F.struct(s["parts"].alias("parts"), more.alias("part")))

        def begun(s: Column, at: Column) -> Column:
            one = F.lit(1)
            return let(gathered(s), lambda g: F.struct(
                at.alias("at"), at.alias("first"), at.alias("last"), one.alias("count"), one.alias("held"),
                F.lit(gain).cast("long").alias("sum"), F.lit(gain).cast("long").alias("peak"), g["parts"].alias("parts"), g["part"].alias("part"),
            ))

        def grown(s: Column, at: Column, total: Column) -> Column:
            count, higher = s["count"] + 1, total > s["peak"]
            return F.struct(
                at.alias("at"), s["first"].alias("first"), F.when(higher, at).otherwise(s["last"]).alias("last"), count.alias("count"), F.when(higher, count).otherwise(s["held"]).alias("held"),
                total.alias("sum"), F.greatest(total, s["peak"]).alias("peak"), s["parts"].alias("parts"), s["part"].alias("part"),
            )

        def step(s: Column, at: Column) -> Column:
            # no unit in reach has more than (2 / least - 2) * n bigrams that aren't the template's
            return let(s["sum"] - loss * (at - s["at"] - 1).cast("long"), lambda left: F.when((left <= 0) | (s["peak"] - left > slack * t["n"].cast("long")), begun(s, at)).otherwise(grown(s, at, left + gain)))

        return F.aggregate(hits, start, step, lambda s: let(gathered(s), lambda g: F.flatten(F.concat(g["parts"], F.array(g["part"])))))

    table, buckets = bigram_table([grams for _, grams in entries])

    def tags_of(pair: Column) -> Column:
        """The tags of the templates that hold the bigram, null if none does."""

        def among(bucket: Column, key: Column) -> Column:
            return F.when(F.contains(bucket, key), F.call_function("substring_index", F.call_function("substring_index", bucket, key, F.lit(-1)), F.lit("\t"), F.lit(1)))

        return let(F.get(table, F.pmod(F.crc32(pair), F.lit(buckets)).cast("int")), lambda bucket: let(F.concat(F.lit("\t"), pair, F.lit("=")), lambda key: among(bucket, key)))

    def candidates(pairs: Column, present: Column) -> Column:
        """(-dice, -n, license, first, last) of every run that reaches its template, the best first."""

        def of(t: Column, hits: Column) -> Column:
            def scored(r: Column) -> Column:
                def rated(own: Column) -> Column:
                    dice = F.lit(2.0) * F.size(F.array_intersect(own, t["grams"])) / (F.size(own) + t["n"])
                    return F.struct((-dice).alias("under"), (-t["n"]).alias("smaller"), t["license"].alias("license"), r["first"].alias("first"), r["last"].alias("last"))

                return let(F.array_distinct(F.slice(pairs, r["first"] + 1, r["last"] - r["first"] + 1)), rated)

            return F.when(F.size(hits) >= t["shared"], F.transform(runs(hits, t), scored)).otherwise(F.array().cast(CANDIDATES))

        def in_places(places: Column) -> Column:
            near = F.filter(known, lambda t: (F.size(places) >= t["shared"]) & F.arrays_overlap(present, t["anchors"]))
            return F.flatten(F.transform(near, lambda t: let(F.filter(places, lambda p: F.contains(p["tags"], t["tag"]))["at"], lambda hits: of(t, hits))))

        places = F.filter(F.transform(pairs, lambda pair, i: F.struct(i.alias("at"), tags_of(pair).alias("tags"))), lambda p: p["tags"].isNotNull())
        return F.array_sort(F.filter(let(places, in_places), lambda c: c["under"] <= -least))

    def passages(line: Column) -> Column:
        of_lines = F.split(line, "\n")
        none = F.array().cast("array<struct<unit: long, dice: double, license: string>>")

        def kept(found: Column, line_of: Column) -> Column:
            def free(c: Column) -> Column:
                own = F.slice(line_of, c["first"] + 1, c["last"] - c["first"] + 2)
                return 2 * F.size(F.filter(own, lambda w: w["found"])) < F.size(own)

            apart = F.aggregate(
                F.filter(found, free),
                F.array().cast(CANDIDATES),
                lambda done, c: F.when(F.exists(done, lambda d: (d["first"] <= c["last"] + 1) & (c["first"] <= d["last"] + 1)), done).otherwise(F.concat(done, F.array(c))),
            )
            rows = F.transform(apart, lambda c: F.struct((-F.get(line_of, c["first"])["line"]).cast("long").alias("unit"), (-c["under"]).alias("dice"), c["license"].alias("license")))
            # what the whole text's row names already is there once; other licences beside it are rows of their own
            whole = F.when(F.size(of_lines) > 1, best(F.replace(line, F.lit("\n"), F.lit(" "))))["license"]
            return F.when(F.size(found) == 0, none).otherwise(let(whole, lambda named: F.filter(rows, lambda c: named.isNull() | (c["license"] != named))))

        def in_words(words: Column, present: Column) -> Column:
            # for every word its line, and whether the line has a row
            per_line = F.transform(of_lines, lambda l, k: F.array_repeat(F.struct((k + 1).alias("line"), best(l).isNotNull().alias("found")), F.size(F.filter(F.split(normalised(l), " "), lambda w: w != ""))))
            return let(candidates_let(words, present), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.flatten(per_line), lambda line_of: kept(found, line_of))))

        def candidates_let(words: Column, present: Column) -> Column:
            return let(pairs_of(words), lambda pairs: candidates(pairs, present))

        def pruned(words: Column) -> Column:
            return let(F.array_distinct(F.filter(words, is_anchor)), lambda present: F.when(F.size(present) == 0, none).otherwise(in_words(words, present)))

        return let(F.split(normalised(line), " "), pruned)

    one = let(best(F.col("line")), lambda b: F.array(F.when(b.isNotNull(), F.struct(F.col("unit").cast("long").alias("unit"), b["dice"].alias("dice"), b["license"].alias("license")))))
    found = listed.select("doc_id", F.explode(F.array_compact(F.when(F.col("unit") == F.col("last"), passages(F.col("line"))).otherwise(one))).alias("best"))
    return found.select("doc_id", "best.unit", "best.license", F.round("best.dice", 6).alias("dice"))


#: Weights of places are whole numbers of this fraction, so that sums are exact.
SCALE = 1_000_000

#: Runs in a part of the array of a text's runs.
PART = 512

RUN = "struct<first: int, last: int>"
CANDIDATES = "array<struct<under: double, smaller: int, license: string, first: int, last: int>>"


def listed_words(words: Sequence[str]) -> Column:
    """The array of the words or bigrams, from one literal."""
    return F.split(F.lit("\n".join(words)), "\n")


def bigram_table(templates: Sequence[Sequence[str]]) -> tuple[Column, int]:
    """(array of strings, their number): bigram b is in the string at crc32(b) modulo their number, as "\\tb=,2,5,\\t" if the templates 2 and 5 hold it."""
    holders: dict[str, list[int]] = {}
    for k, grams in enumerate(templates):
        for g in grams:
            holders.setdefault(g, []).append(k)
    size = 2 ** max(4, len(holders).bit_length())
    strings = ["\t"] * size
    for g, ks in holders.items():
        strings[zlib.crc32(g.encode()) % size] += f"{g}=,{','.join(map(str, ks))},\t"
    return listed_words(strings), size


def word_table(words: Sequence[str]) -> tuple[Column, int]:
    """(array of strings, their number): a word stands between tabs in the string at its crc32 modulo their number."""
    size = 2 ** max(4, len(words).bit_length())
    strings = ["\t"] * size
    for w in words:
        strings[zlib.crc32(w.encode()) % size] += f"{w}\t"
    return listed_words(strings), size


def shared_bigrams(grams: Sequence[str], least: float) -> int:
    """How many of a template's bigrams a unit that reaches it holds at least."""
    return math.ceil(round(least / (2 - least) * len(grams), 9))


def anchor_words(templates: Sequence[Sequence[str]], least: float) -> list[str]:
    """Words of which every unit that reaches a template holds one.

    A unit that reaches a template of n bigrams shares at least least / (2 - least) * n of them, so
    it holds one of any n - that + 1. Those with the longest words are taken, as the rarest.
    """
    found = set()
    for grams in templates:
        shared = shared_bigrams(grams, least)
        by_rarity = sorted((max(g.split(" "), key=lambda w: (len(w), w)) for g in grams), key=lambda w: (-len(w), w))
        found.update(by_rarity[: len(grams) - shared + 1])
    return sorted(found)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with `value` bound to a lambda variable."""
    return F.transform(F.array(value), f)[0]


def oracle_sql(least: float = 0.8) -> str:
    """The same scan of the lines and whole texts of `documents` as DuckDB SQL; it has no passages."""
    rows = ", ".join(f"('{name}', [{', '.join(chr(39) + g + chr(39) for g in grams)}])" for name, texts in sorted(all_templates().items()) for grams in map(template_bigrams, texts) if grams)
    return f"""
WITH known(license, grams) AS (VALUES {rows}),
texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT doc_id, CAST(i AS BIGINT) AS unit, lines[i] AS line FROM texts, unnest(range(1, len(lines) + 1)) AS u(i)
  UNION ALL SELECT doc_id, 0, replace(text, chr(10), ' ') FROM texts WHERE len(lines) > 1
),
words AS (SELECT doc_id, unit, string_split(trim(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
cut AS (SELECT doc_id, unit, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS grams FROM words WHERE len(w) > 1),
scored AS (
  SELECT doc_id, unit, license, 2.0 * len(list_intersect(cut.grams, known.grams)) / (len(cut.grams) + len(known.grams)) AS dice
  FROM cut JOIN known ON 2 * least(len(cut.grams), len(known.grams)) >= {least} * (len(cut.grams) + len(known.grams))
)
SELECT doc_id, unit, arg_min(license, (-dice, license)) AS license, round(max(dice), 6) AS dice
FROM scored WHERE dice >= {least} GROUP BY doc_id, unit
"""
