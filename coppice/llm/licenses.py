"""Operator 3: licence texts found by the Dice coefficient of word bigrams.

Each line, paragraph and whole text is a unit. Normalised (lower case, other than letters and digits to one space), a
unit of s bigrams can reach Dice d with a template of t bigrams only if d / (2 - d) <= s / t <= (2 - d) / d; units that
fit no template are dropped before their bigrams are made. The bigrams are joined with the templates' (a table bounded
by MOST_BIGRAMS), the size bound being part of the join, and summed.

A notice within longer text is found by windows: of each text's words, the runs of a template's size. Shifted to its
first bigram shared with the template a window loses none, so only windows that start there are tried, and of these the
ones with as many such bigrams as Dice d needs; of overlapping ones the best is returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.plans.materialize import table

#: Notices and standard headers of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: Words that most English texts hold.
COMMON = set("a all an and any are as at be by can for from if in is it may not of on one or that the this to under use was with you your".split())
#: Bound of the broadcast table; more templates are refused.
MOST_BIGRAMS = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def bigrams(w: Column) -> Column:
    return F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def telling(bodies: list[list[str]], percent: int) -> list[str]:
    """Words of which a text that reaches percent with one of the templates (their words) holds one at least: of each
    template those, COMMON ones last, then longest first, that touch more of its bigrams than it can do without. Each has a bigram at least."""
    out = set()
    for w in bodies:
        t = len(w) - 1
        spare, touched = t - -(-t * percent // (200 - percent)), set()
        for word in sorted(set(w), key=lambda x: (x in COMMON, -len(x), x)):
            if len(touched) > spare:
                break
            touched |= {i for i in range(t) if word in w[i : i + 2]}
            out.add(word)
    return sorted(out)


def may_hold(body: Column, found: list[str]) -> Column:
    """Whether a text holds one of the words: cheaply anywhere in it first, then among its words."""
    somewhere = F.exists(F.array(F.lower(body)), lambda x: reduce(Column.__or__, [F.contains(x, F.lit(w)) for w in found]))
    return somewhere & F.arrays_overlap(words(body), F.array(*[F.lit(w) for w in found]))


def windows(rows: DataFrame, listed: DataFrame, percent: int) -> DataFrame:
    """row, doc_id, at (word), license, s, t, shared of the template-sized windows of rows(row, doc_id, body)."""
    texts = rows.select("row", "doc_id", bigrams(words(F.col("body"))).alias("b"))
    hits = texts.select("row", "doc_id", F.size("b").alias("total"), F.posexplode("b").alias("at", "bigram")).join(F.broadcast(listed), "bigram")
    text = ["row", "doc_id", "license", "t", "low", "total"]
    ats = hits.repartition("row", "license").groupBy(*text, "most", "bigram").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    # a repeated bigram counts in windows that start after its occurrence ``most`` places before
    ats = ats.select(*text, F.expr("transform(ats, (a, i) -> struct(a as at, if(i >= most, ats[cast(i - most as int)], -1) as prior))").alias("hits"))
    found = ats.groupBy(*text).agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits")).where("size(hits) >= low")
    dense = F.expr("filter(sequence(0, cast(size(hits) - low as int)), i -> hits[cast(i + low - 1 as int)].at < hits[i].at + t)")
    found = found.withColumn("i", F.explode(dense)).withColumn("at", F.expr("hits[i].at")).withColumn("s", F.least("t", F.col("total") - F.col("at")))
    found = found.withColumn("shared", F.expr("size(filter(slice(hits, i + 1, t), x -> x.at < at + t and x.prior < at))").cast("long"))
    found = found.where(F.col("shared") * 200 >= (F.col("s") + F.col("t")) * percent)
    key = F.struct((-2 * F.col("shared") / (F.col("s") + F.col("t"))).alias("rank"), "at", "s", "shared")
    found = found.groupBy("row", "doc_id", "license", "t").agg(F.sort_array(F.collect_list(key)).alias("all"))
    best = F.expr("aggregate(all, filter(all, x -> false), (best, x) -> if(exists(best, y -> abs(y.at - x.at) <= t), best, concat(best, array(x))))")
    return found.select("row", "doc_id", "license", "t", F.explode(best).alias("x")).select("row", "doc_id", "license", "t", "x.at", "x.s", "x.shared")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, at, license, shared, dice for each unit and template of Dice percent / 100 or more.

    kind is line, paragraph (between empty lines, if there are any), document (if of several lines) or window (words in a
    row, of the template's size, anywhere in the text; at is its first word); at counts from 0. Repeated bigrams count as often as both have them. A null or empty text, and units of one word, find nothing.
    Repeated rows find theirs each; a null doc_id is carried. Ties are all returned. Other columns are ignored.
    """
    spark = docs.sparkSession
    listed = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license string, body string").select("license", words(F.col("body")).alias("w"))
    listed = listed.where("size(w) > 1")
    bodies = [r["w"] for r in listed.select("w").collect()]  # a row a template
    listed = listed.select("license", (F.size("w") - 1).alias("t"), F.explode(bigrams(F.col("w"))).alias("bigram")).groupBy("license", "t", "bigram").agg(F.count("*").alias("most"))
    sizes = [r["t"] for r in listed.select("license", "t").distinct().collect()]
    if sum(sizes) > MOST_BIGRAMS:
        raise ValueError(f"templates of more than {MOST_BIGRAMS} bigrams in all")
    low = F.ceil(F.col("t") * percent / F.lit(200 - percent))
    high = F.floor(F.col("t") * (200 - percent) / F.lit(percent))
    listed = listed.withColumn("low", low).withColumn("high", high)
    fits = F.lit(False)
    for t in sorted(set(sizes)):
        fits = fits | F.col("s").between(-(-t * percent // (200 - percent)), t * (200 - percent) // percent)

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("body")).where(may_hold(F.col("body"), telling(bodies, percent)) if bodies else F.lit(False))
    rows = table(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "body"), "licence-texts")
    whole = F.when(F.contains("body", F.lit("\n")), F.array("body")).otherwise(F.array().cast("array<string>"))
    blocks = F.when(F.contains("body", F.lit("\n\n")), F.split("body", "\n\n+")).otherwise(F.array().cast("array<string>"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("parts")) for k, v in (("line", F.split("body", "\n")), ("paragraph", blocks), ("document", whole))])
    units = rows.select("row", "doc_id", F.explode(kinds).alias("k")).select("row", "doc_id", "k.kind", F.posexplode("k.parts").alias("at", "unit"))
    units = units.select("row", "doc_id", "kind", "at", words(F.col("unit")).alias("w")).withColumn("s", F.size("w") - 1).where(fits)
    found = units.select("row", "doc_id", "kind", "at", "s", F.explode(bigrams(F.col("w"))).alias("bigram"))
    found = found.join(F.broadcast(listed), "bigram").where("s between low and high")
    found = found.groupBy("row", "doc_id", "kind", "at", "license", "s", "t", "bigram", "most").agg(F.count("*").alias("n"))
    found = found.groupBy("row", "doc_id", "kind", "at", "license", "s", "t").agg(F.sum(F.least("n", "most")).alias("shared"))
    found = found.where(F.col("shared") * 200 >= (F.col("s") + F.col("t")) * percent)
    columns = ["doc_id", "kind", "at", "license", "s", "t", "shared"]
    found = found.select(*columns).union(windows(rows, listed, percent).withColumn("kind", F.lit("window")).select(*columns))
    return found.select("doc_id", "kind", "at", "license", "shared", F.round(2 * F.col("shared") / (F.col("s") + F.col("t")), 9).alias("dice"))
