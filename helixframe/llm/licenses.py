"""License scan: phrases, and an exact set-similarity join of text blocks with license templates; DataFrame functions alone.

Join. A template's tokens are put in one global order, by how many documents hold them (all documents are counted), rare ones
first. A block contains the share `CONTAINMENT` of a template only if it holds one of the template's first |T| - o + 1 tokens
(prefix; o: the tokens it must share), has o template tokens at all (length), and behind the matching places enough tokens
are left on both sides (position). Candidates are then compared whole. Blocks are the lines of a text and, where blank lines
divide it, its paragraphs. Documents without any prefix token take no part in the join.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import lower_ascii, stored

# The phrases of the contract with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices and opening paragraphs of common licenses, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
)
CONTAINMENT = 0.9
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text) -> F.Column:
    """The words of a lower-cased text, as an array."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def tokens_of(template: str) -> list[str]:
    return sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", template.lower())))


def needed(size: int, containment: float) -> int:
    return max(1, math.ceil(containment * size - 1e-9))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each template token stands; counted over all rows, at most a number for each token comes back."""
    found = docs.select(F.explode(F.array_intersect(words(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("token")).groupBy("token").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["token"]: r["count"] for r in found}


def _literal(values: list) -> F.Column:
    return F.array(*map(F.lit, values))


def _places(word_array, phrase: str) -> F.Column:
    """Where the phrase's words stand consecutively, as word numbers from 0."""
    parts = phrase.split()
    last = F.size(word_array) - len(parts)

    def same(i):
        return reduce(lambda a, b: a & b, [F.element_at(word_array, i + k + 1) == p for k, p in enumerate(parts)])

    return F.when(F.arrays_overlap(word_array, _literal(parts[:1])) & (last >= 0), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), same)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", containment: float = CONTAINMENT, templates: tuple = TEMPLATES) -> DataFrame:
    """A row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base columns are of the phrases' places; labels joins theirs with those of the templates that some block contains; score
    is the largest containment found, 1 for a phrase, 0 for nothing. A null text counts as empty. Repeated rows are scanned
    each; null keys are kept; other columns are ignored.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sets = [(k, label, tokens_of(t)) for k, (label, t) in enumerate(templates)]
    vocabulary = sorted({t for _, _, own in sets for t in own})
    count = frequencies(source, vocabulary)
    order = {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (count[t], t)))}
    index, whole = [], []
    for k, label, own in sets:
        ranked, o = sorted(own, key=order.get), needed(len(own), containment)
        index += [(t, k, i, len(own), o) for i, t in enumerate(ranked[: len(own) - o + 1])]
        whole.append((k, label, ranked))
    spark = docs.sparkSession
    # both tables are as large as the template list, whatever the corpus
    index_table = F.broadcast(spark.createDataFrame(index, "token string, template int, i int, size int, o int"))
    template_table = F.broadcast(spark.createDataFrame(whole, "template int, label string, tokens array<string>"))
    prefixes = sorted({x[0] for x in index})

    worded = source.withColumn("words", words(F.col("text")))
    places = F.array_sort(F.flatten(F.array(*(_places(F.col("words"), p) for p in PHRASES))))
    first_words = sorted({p.split()[0] for p in PHRASES})
    maybe = F.arrays_overlap("words", _literal(first_words))
    labels = F.array_compact(F.array(*(F.when(F.size(_places(F.col("words"), p)) > 0, F.lit(label)) for p, label in PHRASES.items())))
    table = worded.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", F.size("words").cast("long").alias("n_words"), F.when(maybe, places).otherwise(F.array().cast("array<int>")).alias("places"),
        F.when(maybe, F.array_sort(F.array_distinct(labels))).otherwise(F.array().cast("array<string>")).alias("base"), F.when(F.arrays_overlap("words", _literal(prefixes)), F.col("text")).alias("candidate"),
    )
    table = stored(table, "license-scan")

    # tokens of a block that any template has, as places in the global order
    ranks = F.map_from_arrays(_literal(list(order)), _literal(list(order.values())))
    paragraphs = F.filter(F.split("candidate", r"\n[ \t\r]*\n"), lambda p: p.contains("\n"))
    blocks = table.where("candidate IS NOT NULL").select("uid", F.explode(F.array_distinct(F.concat(F.split("candidate", "\n"), paragraphs))).alias("block"))
    blocks = blocks.select("uid", F.array_intersect(words(F.col("block")), _literal(vocabulary)).alias("tokens")).where(F.size("tokens") > 0).distinct()
    ranked = blocks.select("uid", F.transform(F.array_sort(F.transform("tokens", lambda t: F.struct(F.element_at(ranks, t).alias("r"), t.alias("t")))), lambda x: x["t"]).alias("tokens"))
    probes = ranked.where(F.arrays_overlap("tokens", _literal(prefixes))).select("uid", "tokens", F.posexplode("tokens").alias("j", "token")).where(F.col("token").isin(prefixes))
    enough = (F.size("tokens") >= F.col("o")) & (F.col("j") <= F.size("tokens") - F.col("o")) & (F.least(F.col("size") - F.col("i"), F.size("tokens") - F.col("j")) >= F.col("o"))
    pairs = probes.join(index_table, "token").where(enough).select("uid", F.col("tokens").alias("own"), "template", "o").distinct()
    shared = F.size(F.array_intersect("own", "tokens"))
    found = pairs.join(template_table, "template").where(shared >= F.col("o")).groupBy("uid").agg(F.collect_set("label").alias("more"), F.max(shared / F.size("tokens")).alias("contained"))
    out = table.drop("candidate").join(found, "uid", "left")
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.when(F.size("places") > 0, F.array_min("places")).cast("long").alias("first_word"), F.when(F.size("places") > 0, F.array_max("places")).cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )
