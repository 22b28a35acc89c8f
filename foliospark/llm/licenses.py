"""Licence scans by a positional rare-token index.

Licence notices are indexed by their words of highest inverse document frequency (over the notices), each with its
position. A text's rare words look up the notices; each hit votes for the place where that notice would
start; votes of distinct anchors for one place are counted. A notice whose best place (the first of equals) gets enough votes is reported
if all its mandatory key phrases stand where that place puts them, give or take SLACK words. Fixed phrases give the base labels.

Everything is an expression over one row: no shuffle, no Python. Null and empty texts have no words, no labels and score 0; the score is
1 with a base label, else the largest share of anchors that a reported notice has. Repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Words of public licence notices, and the phrases of each that must all stand in a text. The label is what stands before the slash.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["hereby granted free of charge", "deal in the software without restriction"]),
    "apache": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2", "except in compliance with the license"]),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", ["gnu general public license", "free software foundation"]),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license", "free software foundation"]),
    "agpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license", "free software foundation"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "following conditions are met"]),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["source code form is subject", "mozilla public license"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted", "appear in all copies"]),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["without any express or implied warranty", "authors be held liable"]),
    "boost": ("distributed under the boost software license version 1 0 see accompanying file", ["boost software license"]),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license", ["accompanying materials", "eclipse public license"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["free and unencumbered software", "public domain"]),
    "wtfpl": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ["verbatim or modified copies", "as long as the name is changed"]),
    "gpl/notice": ("this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    "mit/notice": ("released under the mit license", ["released under the mit license"]),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["to the extent possible under law", "waived all copyright"]),
    "cc-by-nc-sa": ("this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ["creative commons attribution noncommercial sharealike"]),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    "cc-by-nc": ("licensed under cc by nc", ["cc by nc"]),
}
ANCHORS = 6
#: Words by which a key phrase may stand off its place.
SLACK = 8
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def anchors(templates: dict[str, tuple[str, list[str]]] = TEMPLATES, k: int = ANCHORS) -> dict[str, list[tuple[str, int]]]:
    """For each template its k words of highest IDF (ties: longer, then earlier) with their first position."""
    df = Counter(w for text, _ in templates.values() for w in set(text.split()))
    out = {}
    for label, (text, _) in templates.items():
        words = text.split()
        first = {w: words.index(w) for w in set(words)}
        out[label] = sorted(first.items(), key=lambda x: (-math.log(len(templates) / df[x[0]]), -len(x[0]), x[1]))[:k]
    return out


def _next_words(hits: Column, words: list[str]) -> Column:
    """Start positions at which the words stand consecutively; hits: array of (pos, word) in order, holding every one of these words."""

    def stands(x: Column, i: Column) -> Column:
        ok = x["word"] == words[0]
        for k, w in enumerate(words[1:], 1):
            y = F.get(hits, i + k)
            ok = ok & (y["pos"] == x["pos"] + k) & (y["word"] == w)
        return F.coalesce(ok, F.lit(False))

    return F.transform(F.filter(hits, stands), lambda x: x["pos"])


def _place(hits: Column, posts: list[tuple[str, int]]) -> Column:
    """struct(best: most anchors that agree on one place of the notice, place: the first such). Anchors of one place are distinct words."""
    rel = F.create_map(*[F.lit(v) for p in posts for v in p])
    places = F.array_sort(F.transform(F.filter(hits, lambda x: x["word"].isin([w for w, _ in posts])), lambda x: x["pos"] - rel[x["word"]]))
    zero = F.struct(F.lit(-(2**31)).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("place"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["at"] == x, acc["run"] + 1).otherwise(F.lit(1))
        more = run > acc["best"]
        return F.struct(x.alias("at"), run.alias("run"), F.when(more, run).otherwise(acc["best"]).alias("best"), F.when(more, x).otherwise(acc["place"]).alias("place"))

    return F.aggregate(places, zero, step)


def _stands(tokens: Column, lead: Column, phrase: str, template: str, place: Column) -> Column:
    """Whether the phrase stands within SLACK words of where the place of its template puts it. tokens: as split, `lead` of them before the first word."""
    words, own = phrase.split(), template.split()
    at = next(i for i in range(len(own)) if own[i : i + len(words)] == words)
    start = lambda i: place + lead + i
    said = lambda i: F.translate(F.array_join(F.slice(tokens, start(i) + 1, len(words)), " "), UPPER, LOWER)
    near = F.sequence(F.lit(at - SLACK), F.lit(at + SLACK))
    return F.exists(near, lambda i: F.when(start(i) >= 0, said(i) == phrase).otherwise(False))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", need: float = 0.6) -> DataFrame:
    """One row a document: n_words, places of fixed phrases, labels and score.

    Long intermediate arrays stay inside one row; the hit array has only words of the licence vocabulary.
    """
    index = anchors()
    vocabulary = sorted({w for posts in index.values() for w, _ in posts} | {w for p in PHRASES for w in p.split()})
    d = docs.select(F.col(id_col).alias("doc_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), SEPARATOR).alias("_t"))
    lead = (F.col("_t")[0] == "").cast("int")
    trail = F.when(F.size("_t") > 1, (F.element_at("_t", -1) == "").cast("int")).otherwise(0)
    d = d.select("doc_id", "_t", lead.alias("_lead"), (F.size("_t") - lead - trail).cast("long").alias("n_words"))
    at = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: F.lower(F.get(F.col("_t"), i)).isin(vocabulary))
    d = d.select("doc_id", "n_words", "_t", "_lead", F.transform(at, lambda i: F.struct((i - F.col("_lead")).alias("pos"), F.translate(F.get(F.col("_t"), i), UPPER, LOWER).alias("word"))).alias("_hits"))
    d = d.select("doc_id", "n_words", "_t", "_lead", F.filter("_hits", lambda x: x["word"].isin(vocabulary)).alias("_hits"))

    hits = F.col("_hits")
    d = d.select("doc_id", "n_words", "_t", "_lead", "_hits", *[_next_words(hits, p.split()).alias(f"_p{i}") for i, p in enumerate(PHRASES)], *[F.when(F.size(hits) > 1, _place(hits, posts)).alias(f"_v{i}") for i, posts in enumerate(index.values())])
    places = F.concat(*[F.col(f"_p{i}") for i in range(len(PHRASES))])
    found = [F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]
    shares, own = [], []
    for i, (label, (template, keys)) in enumerate(TEMPLATES.items()):
        n, v = len(index[label]), F.col(f"_v{i}")
        ok = v["best"] >= max(2, math.ceil(need * n))
        for k in keys:
            ok = ok & _stands(F.col("_t"), F.col("_lead"), k, template, v["place"])
        verified = F.when(ok, v["best"] / F.lit(float(n)))
        shares.append(verified)
        own.append(F.when(verified.isNotNull(), F.lit(label.split("/")[0])))
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
    n_base = F.size(places).cast("long")
    return d.select(
        "doc_id", "n_words", n_base.alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        text(found).alias("base_labels"), text([*found, *own]).alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.when(n_base > 0, 1.0).otherwise(0.0), *[F.coalesce(s, F.lit(0.0)) for s in shares])).alias("score"),
    )
