"""License scans: normalised text against licence templates by Dice over word bigrams.

A text is cut into its lines and sentences. Each is normalised (lower case, all
but letters and digits is a space) and becomes its set of word bigrams. It is
compared only to templates of a size that can reach the threshold: with a and b
bigrams Dice is at most 2 min(a, b) / (a + b). Notices that span lines, go on
within a sentence, or stand behind comment marks, and the clauses of whole
licences (``BODIES``), are found by windows over the words of the whole text, but
for the parts that match already. The bound gives the lengths of windows, and
how many bigrams of a template a text must hold before any window is looked at;
texts without any of some rare words, of which every match has one, are not even
cut. All of it is one projection over a row, in DataFrame functions, so nothing
is shuffled.

Defined results: null and empty texts match nothing; texts of any length are
scanned whole; repeated rows are scanned each; a null id stays null; an empty
table gives no rows; of equal similarities the smaller licence name is best;
other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.license_texts import clauses

#: Notices and opening clauses of public licences: (name, text). Fixed values.
TEMPLATES = (
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: What only windows are compared to: clauses of whole licences, and a notice.
BODIES = (("mit", "Licensed under the MIT License."), *clauses())
THRESHOLD = 0.8
_CUT = r"\n|[.!?] "
_GAP = r"[^\p{L}\p{N}]+"
_LETTERLESS = r"[^\p{L}\p{N}]"
_WALL = "\n \n"
_MATCHES = "array<struct<segment:int,license:string,dice:double>>"
#: Words that tell little, tried last.
_COMMON = ("a", "any", "by", "for", "in", "is", "of", "or", "the", "this", "to", "use", "with", "work")


def _bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(" ".join(x) for x in zip(words, words[1:])))  # noqa: B905


def _rare(sets: list[tuple[str, list[str]]], reach: float) -> list[str]:
    """Words of which every window near one of ``sets`` holds one: one of so many of a set's bigrams has one of them."""
    chosen: set[str] = set()
    for _, b in sets:
        own = {w for w in chosen if any(w in x.split() for x in b)}
        words = sorted({w for x in b for w in x.split()} - own, key=lambda w: (w in _COMMON, -len(w), w))
        while sum(not own.isdisjoint(x.split()) for x in b) <= len(b) - math.ceil(len(b) * reach - 1e-9):
            own.add(words.pop(0))
        chosen |= own
    return sorted(chosen)


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _windows(rest: Column, templates, threshold: float) -> Column:
    """Matches of windows over ``rest`` (w, segment): of those of a licence that overlap, the best.

    A window begins and ends with a bigram of the template: without others at its edges its Dice is higher.
    """
    reach = threshold / (2 - threshold)
    sets = [(name, _bigrams(text), len(re.sub(r"[\W_]+", " ", text).split()) - 1) for name, text in templates]
    sets = [x for x in sets if x[1]]
    known = F.array(
        *[
            F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, b)).alias("b"), F.lit(len(b)).alias("n"), F.lit(math.ceil(len(b) * reach - 1e-9)).alias("least"), F.lit(math.floor(size / reach + 1e-9)).alias("most"))
            for n, b, size in sets
        ]
    )
    every = sorted({x for _, b, _ in sets for x in b})

    def of_template(t: Column, b: Column, hits: Column) -> Column:
        def best(s: Column, k: Column, own: Column) -> Column:
            near = F.filter(F.slice(own, k + 1, t["most"]), lambda e: e["at"] < s["at"] + t["most"])

            def scored(e: Column) -> Column:
                size = e["at"] - s["at"] + 1
                dice = lambda d: F.when(F.array_contains(d, _WALL), 0.0).otherwise(F.size(F.array_intersect(d, t["b"])) * F.lit(2.0) / (F.size(d) + t["n"]))
                return F.struct((-_let(F.array_distinct(F.slice(b, s["at"] + 1, size)), dice)).alias("d"), (-size).alias("size"), s["at"].alias("at"), t["license"].alias("license"))

            ends = lambda near: F.when(F.size(F.array_distinct(F.transform(near, lambda e: e["g"]))) >= t["least"], F.array_min(F.transform(F.filter(near, lambda e: e["at"] - s["at"] + 1 >= t["least"]), scored)))
            return _let(near, ends)

        starts = lambda own: F.filter(F.transform(own, lambda s, k: best(s, k, own)), lambda x: F.coalesce(-x["d"] >= threshold, F.lit(False)))
        return _let(F.filter(hits, lambda h: F.array_contains(t["b"], h["g"])), starts)

    def kept(found: Column) -> Column:
        apart = lambda k, x: (k["license"] != x["license"]) | (k["at"] - k["size"] < x["at"]) | (x["at"] - x["size"] < k["at"])
        return F.aggregate(F.array_sort(found), F.filter(found, lambda x: F.lit(False)), lambda done, x: F.when(F.forall(done, lambda k: apart(k, x)), F.concat(done, F.array(x))).otherwise(done))

    def of_text(r: Column) -> Column:
        words = F.transform(r, lambda x: x["w"])
        grams = F.zip_with(F.slice(words, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(words, 2, F.size(r)), lambda x, y: F.concat_ws(" ", x, y))
        hits = lambda b: F.filter(F.transform(b, lambda g, i: F.struct(i.alias("at"), g.alias("g"))), lambda h: h["g"].isin(every))
        held = lambda h: F.array_distinct(F.transform(h, lambda x: x["g"]))
        near = lambda d: F.filter(known, lambda t: F.size(F.array_intersect(t["b"], d)) >= t["least"])
        found = lambda b: _let(hits(b), lambda h: _let(_let(held(h), near), lambda few: F.flatten(F.transform(few, lambda t: of_template(t, b, h)))))
        out = _let(_let(grams, found), kept)
        return F.transform(out, lambda x: F.struct(r[x["at"]]["segment"].alias("segment"), x["license"].alias("license"), (-x["d"]).alias("dice")))

    return _let(rest, of_text)


def match_licenses(df: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", bodies: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """One row for each row of ``df``: id, and matches (segment, license, dice), a segment counted from 0; ``threshold`` is above 0.

    ``bodies``: windows over what no segment matches are compared to these and ``templates``
    as well, and counted at the segment in which they begin; None: segments only.
    """
    sets = [(name, _bigrams(text)) for name, text in templates]
    sets = [(name, b) for name, b in sets if b]
    reach = threshold / (2 - threshold)
    least = min((math.ceil(len(b) * reach - 1e-9) for _, b in sets), default=1)
    most = max((math.floor(len(b) / reach + 1e-9) for _, b in sets), default=0)
    known = F.array(*[F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, b)).alias("b"), F.lit(len(b)).alias("n")) for n, b in sets]).cast("array<struct<license:string,b:array<string>,n:int>>")
    low = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    parts = F.split(low, _CUT)
    # a match holds one of these words; most texts hold none, and are not taken apart
    rare = _rare([*sets, *((n, _bigrams(t)) for n, t in bodies or ())], reach)
    if not rare:  # no templates
        return df.select(F.col(id_col).alias(id_col), F.array().cast(_MATCHES).alias("matches"))
    some = F.arrays_overlap(F.split(low, _LETTERLESS), F.array(*map(F.lit, rare)))
    found = lambda matches: F.when(some, matches).otherwise(F.array().cast(_MATCHES)).alias("matches")
    every_word: Column = F.transform(parts, lambda s, i: F.struct(i.alias("segment"), F.split(F.trim(F.regexp_replace(s, _GAP, " ")), " ").alias("w")))
    pair = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b)))

    def against(x: Column) -> Column:
        n = F.size(x["b"])
        near = F.filter(known, lambda t: F.least(n, t["n"]) * 2 >= F.lit(threshold) * (n + t["n"]))
        dice = lambda t: F.size(F.array_intersect(x["b"], t["b"])) * F.lit(2.0) / (n + t["n"])
        return F.transform(near, lambda t: F.struct(x["segment"].alias("segment"), t["license"].alias("license"), dice(t).alias("dice")))

    def by_parts(words: Column) -> Column:
        # repeated bigrams count once, so that a part may have more words than bigrams, but not fewer
        sized = F.filter(words, lambda x: F.size(x["w"]) > least)
        paired = F.filter(F.transform(sized, lambda x: F.struct(x["segment"].alias("segment"), pair(x["w"]).alias("b"))), lambda x: F.size(x["b"]).between(least, most))
        return F.filter(F.flatten(F.transform(paired, against)), lambda m: m["dice"] >= threshold)

    if bodies is None:
        return df.select(F.col(id_col).alias(id_col), found(by_parts(every_word)))
    wall = F.array(F.lit("\n"), F.lit("\n"))  # no window reaches over a match
    plain = lambda x, done: F.when(F.array_contains(done, x["segment"]), wall).otherwise(F.filter(x["w"], lambda w: w != ""))
    rest = lambda words, done: F.flatten(F.transform(words, lambda x: F.transform(plain(x, done), lambda w: F.struct(w.alias("w"), x["segment"].alias("segment")))))
    more = lambda words, m: _let(F.transform(m, lambda x: x["segment"]), lambda done: _windows(rest(words, done), (*templates, *bodies), threshold))
    both = lambda words: _let(by_parts(words), lambda m: F.concat(m, more(words, m)))
    return df.select(F.col(id_col).alias(id_col), found(_let(every_word, both)))


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """The licences named in every document."""
    found = match_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), bodies=BODIES)
    best = F.array_min(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"))))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        best["license"].alias("best_license"),
        F.round(-best["d"], 6).alias("best_dice"),
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP8_SQL = rf"""
WITH template(license, b) AS (VALUES {", ".join(f"({_sql_text(n)}, [{', '.join(map(_sql_text, _bigrams(t)))}])" for n, t in TEMPLATES)}
), parts AS (
  SELECT doc_id, unnest(range(len(p))) AS segment, unnest(p) AS part
  FROM (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '{_CUT}') AS p FROM documents)
), words AS (
  SELECT doc_id, segment, string_split(trim(regexp_replace(part, '{_GAP}', ' ', 'g')), ' ') AS w FROM parts
), pairs AS (
  SELECT doc_id, segment, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM words WHERE len(w) >= 2
), dice AS (
  SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(p.b, t.b)) / (len(p.b) + len(t.b)) AS d FROM pairs p JOIN template t ON list_has_any(p.b, t.b)
), hit AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, min({{'d': -d, 'l': license}}) AS best FROM dice WHERE d >= {THRESHOLD} GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, best.l AS best_license, round(-best.d, 6) AS best_dice
FROM documents d LEFT JOIN hit USING (doc_id)
"""
