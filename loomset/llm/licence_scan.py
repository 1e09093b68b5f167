"""License scans: normalised text compared to licence templates by the Dice coefficient.

Segments of a document (each line, each paragraph and the whole text) and the templates are brought to
lower-case ASCII words; the similarity is the Dice coefficient of their sets of word bigrams. From
the sizes alone a coefficient of at least t needs a segment of t / (2 - t) to (2 - t) / t times the
template's bigrams, so templates out of these bounds are never compared. A notice inside a longer
segment is found by windows: all runs of the whole text's words of up to (2 - t) / t times the template's
length. A window at the threshold shares t / (2 - t) of the template's bigrams, so it has one of any
few more than the rest (anchors), and texts without anchors are never searched. All DataFrame expressions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.common import table

#: Public notices of common licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def template_rows(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return [(name, template_bigrams(t)) for name, texts in templates.items() for t in texts]


def window_rows(templates: dict[str, list[str]], threshold: float) -> list[tuple[list[str], int, int, list[str]]]:
    """For each template: its bigrams, how many a window must share, the most places of a window, its anchors."""
    out = []
    for text in (t for texts in templates.values() for t in texts):
        grams, places = template_bigrams(text), len(re.findall("[a-z0-9]+", text.lower())) - 1
        need = max(1, math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9))
        anchors = sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - need + 1]
        out.append((grams, need, max(1, math.floor((2 - threshold) / threshold * places + 1e-9)), anchors))
    return out


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def best_windows(words: Column, column: Column, known: list[str]) -> Column:
    """The best window of each template, as far as one shares enough: ``minus`` its coefficient, ``licence`` and ``t``.

    A window that starts or ends between the template's bigrams is never better than one cut to them; equal
    stretches of a text are searched once.
    """

    def of(b: Column, hits: Column, t: Column) -> Column:
        size, need, span = F.size(t["grams"]), t["need"], t["span"]

        def search(own: Column) -> Column:
            near = lambda h, i: F.filter(F.slice(own, i + 1, span), lambda x: x["at"] < h["at"] + span)
            starts = F.filter(own, lambda h, i: F.size(F.array_distinct(F.transform(near(h, i), lambda x: x["gram"]))) >= need)
            stretches = F.array_distinct(F.transform(starts, lambda h: F.array_join(F.slice(b, h["at"], span), "|")))
            dice = lambda g: 2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + size)
            each = lambda v: F.array_max(F.transform(F.sequence(need, F.size(v)), lambda n: bind(F.array_distinct(F.slice(v, 1, n)), dice)))
            return F.struct((-F.array_max(F.transform(stretches, lambda s: bind(F.split(s, "\\|", -1), each)))).alias("minus"), t["licence"].alias("licence"), t["t"].alias("t"))

        return bind(F.filter(hits, lambda h: F.array_contains(t["grams"], h["gram"])), search)

    def in_text(b: Column) -> Column:
        hits = F.filter(F.transform(b, lambda g, i: F.struct((i + 1).alias("at"), g.alias("gram"))), lambda h: h["gram"].isin(known))
        return bind(hits, lambda h: F.transform(column, lambda t: of(b, h, t)))

    grams = lambda w: F.transform(F.slice(w, 2, F.size(w)), lambda x, i: F.concat_ws(" ", F.get(w, i), x))
    return F.filter(bind(words, lambda w: bind(grams(w), in_text)), lambda m: m["minus"].isNotNull())


def licence_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per input row: the id, ``n_matches``, ``licences`` (sorted, comma-separated), ``best_licence``, ``best_dice``.

    ``n_matches`` counts pairs of a distinct segment and a template at or above ``threshold``, and the templates
    that only a window matches, once each; ``best_dice`` is the best of segments and windows. Without a match the
    last two are null and ``licences`` is empty; ties go to the first name. A null or empty text has no
    match. Repeated rows count each; an empty table gives an empty result; only the two named columns
    are read. Each document stays one row: nothing is exploded or shuffled.
    """
    rows, windows = template_rows(templates or TEMPLATES), window_rows(templates or TEMPLATES, threshold)
    named = lambda t, n, b, need, span: F.struct(F.lit(n).alias("licence"), F.array(*map(F.lit, b)).alias("grams"), F.lit(t).alias("t"), F.lit(need).alias("need"), F.lit(span).alias("span"))
    column = F.array(*(named(t, n, b, *w[1:3]) for t, ((n, b), w) in enumerate(zip(rows, windows, strict=True))))
    known, anchors = sorted({g for w in windows for g in w[0]}), sorted({g for w in windows for g in w[3]})
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    low, high = min(math.ceil(least * len(b) - 1e-9) for _, b in rows), max(math.floor(most * len(b) + 1e-9) for _, b in rows)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("body"))
    segments = F.array_distinct(F.concat(F.split("body", "\n", -1), F.split("body", "\n[ \t]*\n", -1), F.array(F.col("body"))))
    # A segment of n distinct bigrams has more than n words: short ones go by their length alone.
    base = base.select("id", F.filter(segments, lambda s: F.length(s) >= 2 * low + 1).alias("segments"))
    norm = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    base = base.withColumn("words", F.transform("segments", lambda s: F.split(norm(s), " ", -1)))
    base = base.withColumn("words", F.filter("words", lambda w: F.size(w) > low))
    grams = lambda w: F.array_distinct(F.transform(F.slice(w, 2, F.size(w)), lambda x, i: F.concat_ws(" ", F.get(w, i), x)))
    base = base.withColumn("all_grams", F.transform("words", grams))
    # The whole text is the last segment.
    anchored = F.exists(F.get("all_grams", F.size("all_grams") - 1), lambda g: g.isin(anchors))
    base = base.select("id", F.filter("all_grams", lambda g: F.size(g).between(low, high)).alias("grams"), F.when(anchored, F.get("words", F.size("words") - 1)).alias("text_words"))
    dice = lambda g, t: 2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + F.size(t["grams"]))
    fits = lambda g, t: 2 * F.least(F.size(g), F.size(t["grams"])) >= F.lit(threshold) * (F.size(g) + F.size(t["grams"])) - 1e-9
    base = base.withColumn("templates", F.when(F.size("grams") > 0, column))
    scored = F.flatten(F.transform("grams", lambda g: F.transform(F.filter("templates", lambda t: fits(g, t)), lambda t: F.struct((-dice(g, t)).alias("minus"), t["licence"].alias("licence"), t["t"].alias("t")))))
    none = F.lit([]).cast("array<struct<minus: double, licence: string, t: int>>")
    good = lambda c, when: F.coalesce(F.filter(F.when(when, c), lambda m: -m["minus"] >= threshold), none)
    base = base.select("id", good(scored, F.size("grams") > 0).alias("found"), good(best_windows(F.col("text_words"), column, known), F.col("text_words").isNotNull()).alias("inside"))
    base = base.select("id", F.size("found").alias("n_found"), F.filter("inside", lambda m: ~F.exists("found", lambda f: f["t"] == m["t"])).alias("only_inside"), F.concat("found", "inside").alias("found"))
    best = F.array_min("found")
    return base.select(
        F.col("id").alias(id_col),
        (F.col("n_found") + F.size("only_inside")).cast("long").alias("n_matches"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["licence"]))), ","), F.lit("")).alias("licences"),
        best["licence"].alias("best_licence"),
        F.round(-best["minus"], 6).alias("best_dice"),
    )


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op5_sql(threshold: float = 0.8) -> str:
    rows = template_rows(TEMPLATES)
    values = ", ".join("('{}', [{}])".format(n, ", ".join(f"'{g}'" for g in b)) for n, b in rows)
    return f"""
WITH t(licence, tg) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS body FROM documents),
s AS (SELECT DISTINCT k, unnest(list_concat(list_concat(string_split(body, chr(10)), regexp_split_to_array(body, '\\n[ \\t]*\\n')), [body])) AS seg FROM d),
w AS (SELECT k, string_split(trim(regexp_replace(lower(seg), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM s),
g AS (SELECT k, list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS sg FROM w WHERE len(ws) >= 2),
m AS (SELECT k, licence, 2.0 * len(list_intersect(sg, tg)) / (len(sg) + len(tg)) AS dice FROM g, t WHERE 2 * least(len(sg), len(tg)) >= {threshold} * (len(sg) + len(tg)) - 1e-9),
a AS (SELECT k, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, max(dice) AS best FROM m WHERE dice >= {threshold} GROUP BY k),
b AS (SELECT m.k, min(licence) AS best_licence FROM m JOIN a ON m.k = a.k AND m.dice = a.best GROUP BY m.k)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(licences, '') AS licences, best_licence, round(CAST(best AS DOUBLE), 6) AS best_dice
FROM d LEFT JOIN a ON d.k = a.k LEFT JOIN b ON d.k = b.k"""
