"""License scan: MinHash bands over overlapping text windows, then exact containment.

Columns and SQL functions only. Words are lower-case runs of letters and digits. A window is
six words, one word apart from the next; its two five-word shingles are hashed. The signature
is made of pairs of opposite orders of the hash space, so that a window's minimum under one
order is its maximum under the other: two bands of one row each. A template's windows and a
document's windows that share any shingle therefore meet in a band with certainty: whichever
shingle of a two-shingle window is shared, it is the minimum under one of the two orders. The
band settings have a miss rate of zero for every match at the containment asked for.

Band keys only retrieve. Each candidate place is verified by exact shingle containment: of the
template's distinct shingles (as words, not hashes) at least 0.8 must occur in the stretch of
the document that the template would cover there, with room for inserted words. Against every
related template of another license, one of the shingles that tell the two apart must occur as well.

Templates are a table (license, text) of at most `MAX_TEMPLATE_WORDS` words together, which
is checked; this bounds what is broadcast. A template needs five words.

Defined cases: null and empty texts, and texts under five words, match nothing and give no row;
a template found at several places of a document gives one row with the first of the best
places and the number of places; repeated documents give repeated rows; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterline.llm.common import once

SHINGLE = 5
LEAST_CONTAINMENT = 0.8
MAX_TEMPLATE_WORDS = 200_000
#: Words that may be inserted in a matching stretch, as a share of the template.
SLACK = 0.25
#: Share of a template's shingles in one of another license from which on the two are told apart.
RELATED = 0.5
#: Constants of the order: hash xor constant, and its complement.
ORDER = 0x5DEECE66D1234567

# Short notices of well-known licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
    ],
    "GPL-2.0": [
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License.",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",
    ],
    "BSD": [
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has dedicated all copyright to this work to the public domain."],
}


def license_templates(spark: SparkSession) -> DataFrame:
    rows = [(name, text) for name, texts in TEMPLATES.items() for text in texts]
    return spark.createDataFrame(rows, "license string, text string")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """64-bit hash of each five-word shingle."""
    at = lambda i, k: F.get(words, i + k)
    return F.when(
        F.size(words) >= SHINGLE,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - SHINGLE),
            lambda i: F.xxhash64(*[at(i, k) for k in range(SHINGLE)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def band_keys(hashes: Column) -> tuple[Column, Column]:
    """Per window the hash that is smallest under the order, and under the opposite order."""
    order = F.lit(ORDER)
    following = F.concat(F.slice(hashes, F.lit(2), F.size(hashes)), F.slice(hashes, -1, 1))

    def pick(first: bool) -> Column:
        # The last window, and the only one of a single shingle, holds one shingle.
        def smaller(a: Column, b: Column) -> Column:
            low = F.least(a.bitwiseXOR(order), b.bitwiseXOR(order))
            high = F.greatest(a.bitwiseXOR(order), b.bitwiseXOR(order))
            return low if first else high

        return F.when(F.size(hashes) > 0, F.zip_with(hashes, following, smaller)).otherwise(hashes)

    return pick(True), pick(False)


def prepared(templates: DataFrame) -> DataFrame:
    """(t, license, words, shingles): numbered templates that have a shingle."""
    named = templates.where("license is not null and text is not null").select(
        "license", words_of(F.col("text")).alias("words")
    )
    return (
        named.where(F.size("words") >= SHINGLE)
        .distinct()
        .select("license", "words", F.xxhash64("license", "words").alias("t"))
    )


def shingles(words: Column) -> Column:
    """The five-word shingles as text."""
    return F.when(
        F.size(words) >= SHINGLE,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - SHINGLE + 1),
            lambda i: F.array_join(F.slice(words, i, F.lit(SHINGLE)), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def scan_licenses(
    docs: DataFrame,
    templates: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: float = LEAST_CONTAINMENT,
) -> DataFrame:
    """(doc_id, license, containment, first_word, n_words, n_places), a row per license found.

    `first_word` counts from zero; `n_words` is the length of the matched template.
    """
    known = prepared(templates)
    size = known.select(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first()["n"]
    if size > MAX_TEMPLATE_WORDS:
        raise ValueError(f"{size} template words; at most {MAX_TEMPLATE_WORDS} can be broadcast")
    hashed = once(known, _h=shingle_hashes(F.col("words")))
    low, high = band_keys(F.col("_h"))
    keys = once(hashed, _low=low, _high=high)
    bands = (
        keys.select("t", F.posexplode("_low").alias("offset", "key"), F.lit(0).alias("band"))
        .unionByName(keys.select("t", F.posexplode("_high").alias("offset", "key"), F.lit(1).alias("band")))
        .distinct()
    )
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    worded = once(slim.where(F.length("text") > 0), words=words_of(F.col("text"))).drop("text")
    signed = once(worded, _h=shingle_hashes(F.col("words")))
    low, high = band_keys(F.col("_h"))
    signed = once(signed, _low=low, _high=high).drop("_h")
    for band, name in ((0, "_low"), (1, "_high")):
        signed = signed.withColumn(f"{name}_map", key_map(bands.where(F.col("band") == band)).scalar())
    # Rows without any template's band key end here; the test costs no shuffle and no rows.
    likely = signed.where(
        F.arrays_overlap("_low", F.map_keys("_low_map")) | F.arrays_overlap("_high", F.map_keys("_high_map"))
    )
    placed = once(likely.withColumn("uid", F.monotonically_increasing_id()), places=F.array_distinct(F.concat(
        met("_low", "_low_map"), met("_high", "_high_map")
    ))).select("uid", "doc_id", "words", F.explode("places").alias("p"))
    return best_places(verified(placed, known, least))


def key_map(bands: DataFrame) -> DataFrame:
    """One row: a map from band key to the templates and offsets that have it."""
    listed = bands.groupBy("key").agg(F.collect_list(F.struct("t", "offset")).alias("of"))
    return listed.agg(F.map_from_entries(F.collect_list(F.struct("key", "of"))).alias("m"))


def met(keys: str, known: str) -> Column:
    """(t, align) structs: the templates met in this band, and the word where each one would begin."""
    hit = F.array_intersect(F.col(keys), F.map_keys(known))
    # Positions of the few hit keys only.
    def of(held: Column) -> Column:
        at = F.filter(
            F.transform(F.col(keys), lambda k, i: F.when(F.array_contains(held, k), F.struct(k.alias("k"), i.alias("i")))),
            lambda x: x.isNotNull(),
        )
        return F.flatten(
            F.transform(
                at,
                lambda x: F.transform(
                    F.element_at(F.col(known), x["k"]),
                    lambda e: F.struct(e["t"].alias("t"), (x["i"] - e["offset"]).alias("align")),
                ),
            )
        )

    return F.get(F.transform(F.array(hit), of), F.lit(0))


def distinguishing(listed: DataFrame) -> DataFrame:
    """(t, marks): for each template of another license that holds most of this one's shingles, those it lacks."""
    other = listed.select(F.col("license").alias("o_license"), F.col("wanted").alias("o_wanted"))
    lacking = F.array_except("wanted", "o_wanted")
    return (
        listed.join(F.broadcast(other), F.col("license") != F.col("o_license"))
        .where((F.size(F.array_intersect("wanted", "o_wanted")) >= RELATED * F.size("wanted")) & (F.size(lacking) > 0))
        .groupBy("t")
        .agg(F.collect_set(lacking).alias("marks"))
    )


def verified(placed: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(uid, doc_id, license, containment, first_word, n_words) of the places that hold enough."""
    listed = known.select("t", "license", "words", F.array_distinct(shingles(F.col("words"))).alias("wanted"))
    listed = listed.join(F.broadcast(distinguishing(listed)), "t", "left")
    joined = placed.join(F.broadcast(listed.withColumnRenamed("words", "template")), F.col("p.t") == F.col("t"))
    n = F.size("template")
    slack = F.ceil(n * SLACK).cast("int")
    start = F.greatest(F.lit(0), F.col("p.align") - slack)
    stretch = once(
        joined.select(
            "uid", "doc_id", "license", "wanted", "marks", n.alias("n_words"), start.alias("start"),
            F.slice("words", start + 1, F.col("p.align") + n + slack - start).alias("part"),
        ),
        found=shingles(F.col("part")),
    )
    share = F.size(F.array_intersect("found", "wanted")) / F.size("wanted")
    first = F.filter(
        F.transform("found", lambda x, i: F.when(F.array_contains("wanted", x), i)), lambda i: i.isNotNull()
    )
    told = F.forall(F.coalesce("marks", F.array()), lambda m: F.arrays_overlap("found", m))
    return (
        stretch.where(told)
        .select(
            "uid", "doc_id", "license", share.alias("containment"), "n_words",
            (F.col("start") + F.get(first, F.lit(0))).alias("first_word"),
        )
        .where(F.col("containment") >= least)
        .distinct()
    )


def best_places(matches: DataFrame) -> DataFrame:
    """One row per document and license; a place inside a better match of another template goes."""
    match = F.struct("license", "containment", "first_word", "n_words")
    of_doc = matches.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.collect_list(match).alias("all"))

    def beaten(m: Column) -> Column:
        return F.exists(
            "all",
            lambda o: (m["first_word"] < o["first_word"] + o["n_words"])
            & (o["first_word"] < m["first_word"] + m["n_words"])
            & (o["license"] != m["license"])
            & (F.struct(o["containment"], o["n_words"]) > F.struct(m["containment"], m["n_words"])),
        )

    kept = of_doc.select("uid", "doc_id", F.explode(F.filter("all", lambda m: ~beaten(m))).alias("m"))
    return (
        kept.groupBy("uid", "m.license")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.max(F.struct("m.containment", "m.n_words", (-F.col("m.first_word")).alias("back"))).alias("best"),
            F.count_distinct("m.first_word").alias("n_places"),
        )
        .select(
            "doc_id",
            "license",
            F.col("best.containment").alias("containment"),
            (-F.col("best.back")).cast("long").alias("first_word"),
            F.col("best.n_words").cast("long").alias("n_words"),
            "n_places",
        )
    )


def op1_license_scan(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs, license_templates(docs.sparkSession))
