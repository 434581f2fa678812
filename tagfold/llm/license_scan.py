"""Operator 9: licence families of paragraphs, by a trained classifier that template comparison confirms.

A paragraph is a line of a text, or a run of neighbouring lines, none without words, whose inner lines hold fewer words than
the longest template: a notice of a template's length, however it is wrapped, lies in such a run. Its words (a-z, 0-9, dots within) give one-word and two-word n-grams; a multinomial
logistic regression over the n-grams that its training table holds names a family or `unknown`. The probability is
calibrated by one temperature, fitted to predictions on rows left out of training, and a family counts from MIN_PROBABILITY
on. It is confirmed if the paragraph holds MIN_SHARE or more of the n-grams of one of the family's templates.

Scoring is DataFrame expressions alone: n-grams are exploded and joined with the weights, a table as small as the training
table. A paragraph must hold a key word to be scored, so the rest is not exploded; a confirmed paragraph always does (`keys`).
Weights are whole numbers (in millionths), so margins do not depend on the order of sums.

Null and empty texts have no paragraphs. Rows of one doc_id count as one document: equal texts count once, and of
different texts a line or run counts once if it is the same at the same place. A null doc_id is one too. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS, RATE, L2, FOLDS = 150, 4.0, 1e-3, 4
MIN_PROBABILITY, MIN_SHARE_PERCENT = 0.5, 60
UNKNOWN = "unknown"

# Wordings by family, and sentences that name no licence.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT", "This project is available under the terms of the MIT License."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License", "Released under the GNU General Public License.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPL."),
    "LGPL": ("Licensed under the GNU Lesser General Public License.", "This library is free software under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1"),
    "BSD": ("Released under the BSD License.", "Licensed under the 3-clause BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under CC BY-NC."),
    "CC0": ("Released under CC0 1.0 Universal, a public domain licence.", "This work is dedicated to the public domain under the CC0 license."),
    "proprietary": ("Copyright. All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission.", "This software is proprietary and confidential; copying without a license is forbidden."),
}
OTHERS = (
    "You need a driving licence to rent a car.", "The fishing license costs ten dollars.", "Their license was revoked last year.", "He asked for permission to leave the room.",
    "Copyright law is taught in the second year.", "The public domain is a legal idea.", "Poetic license lets a writer bend facts.", "The general public is invited to the open day.",
    "She studied at MIT and later in Paris.", "The Apache helicopter landed.", "A gnu is a large antelope.", "The library opens at nine.", "Please read the terms before you sign.",
    "The committee released its report under pressure.", "This work is difficult.", "Version 2.0 of the game sold well.",
)
#: Words of templates that are too common to look for.
COMMON = frozenset("1.0 2.0 2.1 3 3.0 4.0 a all and any are be by can copy file form free general in is it later library may mit no not of or part person software source subject the this to under use v version with work you".split())
TOKEN = r"[^a-z0-9.]+"


def words(text: str) -> list[str]:
    import re

    return [w for w in (x.strip(".") for x in re.split(TOKEN, text.lower())) if w]


def grams(text: str) -> frozenset[str]:
    w = words(text)
    return frozenset(w) | frozenset(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))


def _train(rows, classes: int) -> dict[str, list[float]]:
    """Weights by n-gram; the empty n-gram holds the intercepts."""
    w: dict[str, list[float]] = {"": [0.0] * classes}
    for _, g in rows:
        for x in g:
            w.setdefault(x, [0.0] * classes)
    for _ in range(STEPS):
        step: dict[str, list[float]] = {x: [0.0] * classes for x in w}
        for y, g in rows:
            p = softmax(margins(g, w, classes))
            p[y] -= 1.0
            scale = 1 / len(rows)
            for x in (*g, ""):
                row = step[x]
                for c in range(classes):
                    row[c] -= p[c] * scale
        for x, s in step.items():
            for c in range(classes):
                w[x][c] += RATE * (s[c] - (L2 * w[x][c] if x else 0.0))
    return w


def margins(g, w: dict[str, list[float]], classes: int) -> list[float]:
    out = list(w[""])
    for x in g:
        if x in w:
            for c in range(classes):
                out[c] += w[x][c]
    return out


def softmax(z: list[float], temperature: float = 1.0) -> list[float]:
    top = max(z)
    e = [math.exp((x - top) / temperature) for x in z]
    return [x / sum(e) for x in e]


@lru_cache(maxsize=1)
def model() -> tuple[tuple[str, ...], dict[str, tuple[int, ...]], float]:
    """Classes, weights in millionths, temperature. Deterministic: sums run in sorted order of n-grams."""
    classes = (*TEMPLATES, UNKNOWN)
    rows = [(k, grams(t)) for k, name in enumerate(TEMPLATES) for t in TEMPLATES[name]] + [(len(TEMPLATES), grams(t)) for t in OTHERS]
    rows = [(y, tuple(sorted(g))) for y, g in rows]
    n = len(classes)
    left_out = []
    for fold in range(FOLDS):
        w = _train([r for i, r in enumerate(rows) if i % FOLDS != fold], n)
        left_out += [(y, margins(g, w, n)) for i, (y, g) in enumerate(rows) if i % FOLDS == fold]
    loss = lambda t: -sum(math.log(max(1e-12, softmax(z, t)[y])) for y, z in left_out)
    temperature = min((0.5 * 1.1**k for k in range(30)), key=loss)
    w = _train(rows, n)
    return classes, {x: tuple(round(v * 1e6) for v in row) for x, row in w.items()}, round(temperature, 6)


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(gram, w) and (gram, family, template, size): rows bounded by the training table."""
    _, weights, _ = model()
    w = spark.createDataFrame([(x, list(v)) for x, v in weights.items() if x], "gram string, w array<long>")
    rows = [(x, f, k, len(grams(t))) for f, ts in TEMPLATES.items() for k, t in enumerate(ts) for x in sorted(grams(t))]
    return w, spark.createDataFrame(rows, "gram string, family string, template int, template_size int")


@lru_cache(maxsize=1)
def keys() -> tuple[str, ...]:
    """Words of which every confirmed paragraph holds one: without them, less than MIN_SHARE of any template is left."""
    found = {w for ts in TEMPLATES.values() for t in ts for w in words(t)} - COMMON
    for ts in TEMPLATES.values():
        for g in map(grams, ts):
            if 100 * sum(found.isdisjoint(x.split()) for x in g) >= MIN_SHARE_PERCENT * len(g):
                raise ValueError(f"a template can be confirmed without a key: {sorted(g)}")
    return tuple(sorted(found))


def paragraph_grams(docs: DataFrame) -> DataFrame:
    """(doc_id, src, paragraph, last, line, gram): distinct n-grams of the lines and runs of lines that hold a key and
    enough of some template."""
    key = r"(?:^|[^a-z0-9])(?:" + "|".join(x.replace(".", "[.]") for x in keys()) + r")(?:$|[^a-z0-9])"
    longest = max(len(words(t)) for ts in TEMPLATES.values() for t in ts)
    cleaned = lambda c: F.filter(F.transform(F.split(F.lower(c), TOKEN), lambda x: F.trim(x, F.lit("."))), lambda x: x != "")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.lower("text").rlike(key))
    lines = rows.select("doc_id", F.md5("text").alias("src"), F.split("text", "\n").alias("lines"))
    lines = lines.select("*", F.transform("lines", lambda x: F.size(cleaned(x))).alias("n"), F.transform("lines", lambda x: F.lower(x).rlike(key)).alias("k"))
    spans = f"""flatten(transform(sequence(0, size(lines) - 1), i -> transform(filter(sequence(i, least(i + {longest}, size(lines) - 1)),
      j -> if(i = j, k[i], exists(slice(k, i + 1, j - i + 1), x -> x) and forall(slice(n, i + 1, j - i + 1), x -> x > 0)
        and aggregate(slice(n, i + 2, j - i - 1), 0, (a, x) -> a + x) < {longest})), j -> named_struct('paragraph', i, 'last', j))))"""
    at = lines.select("doc_id", "src", "lines", F.explode(F.expr(spans)).alias("s")).select("doc_id", "src", "s.*", F.expr("array_join(slice(lines, s.paragraph + 1, s.last - s.paragraph + 1), ' ')").alias("col"))
    w = at.select("doc_id", "src", F.col("paragraph").cast("long").alias("paragraph"), F.col("last").cast("long").alias("last"), F.md5("col").alias("line"), cleaned(F.col("col")).alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    held = w.select("doc_id", "src", "paragraph", "last", "line", F.array_distinct(F.concat("w", pairs)).alias("grams"))
    # what holds too little of every template cannot be confirmed
    wanted = [grams(t) for ts in TEMPLATES.values() for t in ts]
    enough = [F.size(F.array_intersect("grams", F.array(*map(F.lit, sorted(g))))) * 100 >= MIN_SHARE_PERCENT * len(g) for g in wanted]
    near = held.where(reduce(Column.__or__, enough))
    return near.select("doc_id", "src", "paragraph", "last", "line", F.explode("grams").alias("gram"))


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, last, line, family, probability, share, counts): lines, and runs of lines from paragraph to last,
    with a confirmed family, `share` in whole percent; `counts` is 1 for a line and for the first of the least runs that
    overlap, else 0."""
    spark = docs.sparkSession
    classes, weights, temperature = model()
    w, templates = _tables(spark)
    n = len(classes)
    # both tables are bounded by the training table
    scored = paragraph_grams(docs).join(F.broadcast(w), "gram", "left")
    key = ["doc_id", "src", "paragraph", "last", "line"]
    # rows repeated as they are would add up their n-grams; their count is taken out again
    z = scored.groupBy(*key, "gram").agg(F.first("w").alias("w"))
    sums = [F.coalesce(F.sum(F.get("w", F.lit(c))), F.lit(0)) + F.lit(weights[""][c]) for c in range(n)]
    held = z.groupBy(*key).agg(F.array(*sums).alias("z"), F.collect_list("gram").alias("grams"))
    top = F.array_max("z")
    e = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp((x - top) / F.lit(1e6 * temperature)))
    best = held.select(*key, "grams", (F.array_position("z", top) - 1).cast("int").alias("class"), (F.lit(1.0) / e).alias("probability"))
    named = best.withColumn("family", F.get(F.array(*map(F.lit, classes)), F.col("class"))).where((F.col("family") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY))
    met = named.select(*key, "family", "probability", F.explode("grams").alias("gram")).join(F.broadcast(templates.withColumnRenamed("family", "of")), "gram")
    shares = met.groupBy(*key, "family", "probability", "of", "template", "template_size").agg(F.count("*").alias("c"))
    shares = shares.withColumn("share", F.expr("(100 * c) div template_size")).where(F.col("share") >= MIN_SHARE_PERCENT)
    confirmed = shares.groupBy(*key, "family", "probability").agg(F.max(F.expr("if(of = family, share, null)")).alias("share"), F.collect_set("of").alias("covers")).where("share is not null")
    # a run says nothing new of a family whose template a line of it, confirmed by itself, holds already
    all_ = confirmed.groupBy("doc_id", "src").agg(F.collect_list(F.struct("paragraph", "last", "line", "family", "probability", "share", "covers")).alias("s"))
    own = all_.withColumn("o", F.expr("filter(s, x -> x.paragraph = x.last)"))
    new = own.withColumn("r", F.expr("filter(s, x -> x.paragraph < x.last and not exists(o, y -> y.paragraph between x.paragraph and x.last and array_contains(y.covers, x.family)))"))
    least = new.withColumn("l", F.expr("filter(r, x -> not exists(r, y -> y.family = x.family and y.paragraph >= x.paragraph and y.last <= x.last and y.last - y.paragraph < x.last - x.paragraph))"))
    first = "filter(l, x -> not exists(l, y -> y.family = x.family and y.paragraph < x.paragraph and y.last >= x.paragraph))"
    marked = least.withColumn("f", F.expr(first)).select("doc_id", F.explode(F.expr("concat(transform(o, x -> struct(x, 1 as counts)), transform(r, x -> struct(x, if(array_contains(f, x), 1, 0) as counts)))")).alias("x"))
    return marked.select("doc_id", "x.x.*", "x.counts").drop("covers")


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, family, paragraphs, probability, share): documents with a confirmed licence; the greatest probability
    (four decimals) and template share (whole percent) of the paragraphs."""
    once = classify(docs).groupBy("doc_id", "paragraph", "last", "line", "family").agg(*(F.max(c).alias(c) for c in ("probability", "share", "counts")))
    return once.groupBy("doc_id", "family").agg(F.sum("counts").alias("paragraphs"), F.round(F.max("probability"), 4).alias("probability"), F.max("share").cast("long").alias("share"))


def oracle() -> str:
    """The definition itself: every line and run is scored, without key words or a look at templates before."""
    classes, weights, temperature = model()
    n = len(classes)
    w = ", ".join(f"('{x}', [{', '.join(map(str, v))}])" for x, v in weights.items() if x)
    t = ", ".join(f"('{x}', '{f}', {k}, {len(grams(s))})" for f, ts in TEMPLATES.items() for k, s in enumerate(ts) for x in sorted(grams(s)))
    longest = max(len(words(t)) for ts in TEMPLATES.values() for t in ts)
    sums = ", ".join(f"(coalesce(sum(w[{c + 1}]), 0) + {weights[''][c]})::bigint" for c in range(n))
    inside = "y.src = x.src AND y.doc_id IS NOT DISTINCT FROM x.doc_id AND y.family = x.family"
    return f"""
      WITH w(gram, w) AS (VALUES {w}), t(gram, family, template, size) AS (VALUES {t}),
      d AS (SELECT DISTINCT doc_id, text, md5(text) AS src FROM documents WHERE text IS NOT NULL),
      l AS (SELECT doc_id, src, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM d),
      k AS (SELECT doc_id, src, p, line, list_filter(list_transform(regexp_split_to_array(lower(line), '{TOKEN}'), lambda x: trim(x, '.')), lambda x: x <> '') AS ws FROM l),
      u AS (SELECT *, sum(len(ws)) OVER v AS upto, sum((len(ws) = 0)::int) OVER v AS blank FROM k WINDOW v AS (PARTITION BY doc_id, src ORDER BY p ROWS UNBOUNDED PRECEDING)),
      r AS (SELECT a.doc_id, a.src, a.p AS paragraph, b.p AS last FROM u a JOIN u b
            ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.src = b.src AND b.p BETWEEN a.p AND a.p + {longest}
            AND (a.p = b.p OR (len(a.ws) > 0 AND a.blank = b.blank AND b.upto - len(b.ws) - a.upto < {longest}))),
      h AS (SELECT r.doc_id, r.src, r.paragraph, r.last, flatten(list(k.ws ORDER BY k.p)) AS ws, md5(string_agg(k.line, ' ' ORDER BY k.p)) AS line
            FROM r JOIN k ON k.doc_id IS NOT DISTINCT FROM r.doc_id AND k.src = r.src AND k.p BETWEEN r.paragraph AND r.last GROUP BY ALL),
      n AS (SELECT row_number() OVER () AS id, * FROM h),
      g AS (SELECT id, unnest(list_distinct(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])))) AS gram FROM n),
      z AS (SELECT id, [{sums}] AS z FROM g LEFT JOIN w USING (gram) GROUP BY id),
      q AS (SELECT id, ({list(classes)})[list_position(z, list_max(z))] AS family,
              1.0 / list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / {1e6 * temperature!r}::double))) AS probability FROM z),
      m AS (SELECT id, t.family AS of, t.template, (100 * count(*)) // t.size AS share FROM q JOIN g USING (id) JOIN t USING (gram)
            WHERE q.family <> '{UNKNOWN}' AND probability >= {MIN_PROBABILITY} GROUP BY id, t.family, t.template, t.size HAVING (100 * count(*)) // t.size >= {MIN_SHARE_PERCENT}),
      s AS (SELECT doc_id, src, paragraph, last, line, family, probability, max(share) FILTER (of = family) AS share, list(DISTINCT of) AS covers
            FROM m JOIN q USING (id) JOIN n USING (id) GROUP BY ALL HAVING max(share) FILTER (of = family) IS NOT NULL),
      o AS (SELECT * FROM s WHERE paragraph = last),
      x AS (SELECT * FROM s x WHERE paragraph < last AND NOT EXISTS (SELECT 1 FROM o y WHERE y.src = x.src AND y.doc_id IS NOT DISTINCT FROM x.doc_id
            AND y.paragraph BETWEEN x.paragraph AND x.last AND list_contains(y.covers, x.family))),
      e AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE {inside} AND y.paragraph >= x.paragraph AND y.last <= x.last AND y.last - y.paragraph < x.last - x.paragraph)),
      f AS (SELECT * FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE {inside} AND y.paragraph < x.paragraph AND y.last >= x.paragraph)),
      c AS (SELECT *, 1 AS counts FROM o UNION ALL
            SELECT x.*, (EXISTS (SELECT 1 FROM f y WHERE {inside} AND y.paragraph = x.paragraph AND y.last = x.last))::int FROM x),
      once AS (SELECT doc_id, paragraph, last, line, family, max(probability) AS probability, max(share) AS share, max(counts) AS counts FROM c GROUP BY ALL)
      SELECT doc_id, family, sum(counts)::bigint AS paragraphs, round(max(probability), 4) AS probability, max(share)::bigint AS share FROM once GROUP BY doc_id, family"""
