"""Licence scans with a positional index of rare words."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

#: Phrases whose every place is reported, with their labels.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Licence passages: label, text, key phrases that must stand at their place in the passage.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2.0-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit-reference", "released under the mit license", ["the mit license"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license"]),
    ("gpl-version", "gnu general public license as published by the free software foundation either version", ["published by the free software foundation"]),
    ("lgpl-notice", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("spdx", "spdx license identifier", ["spdx license identifier"]),
]

INDEX_WORDS, LEAST_MATCH = 12, 0.6
ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str):
    """Words of the text after lower-casing.

    lower() also lowers other letters, but no such letter becomes, or stops being, a separator, and none lowers to
    plain letters of a phrase (the dotted capital I keeps its dot), so places and counts are those of A-Z alone.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _GAP), "")


def _quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, index_words: int = INDEX_WORDS, least_match: float = LEAST_MATCH) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    A first pass counts in how many documents each template word occurs (at most as many counts as the templates
    have words reach the driver). Each template is indexed by its rarest words and their positions. A document looks
    up all its indexed words, so what it is found to hold in one place does not hang on other places. Every occurrence
    becomes (template, place minus position), and an alignment that enough of them share is a candidate; its words are
    then compared in place, and the key phrases must stand there. The base phrases are indexed by all their words and
    need all of them. Null and empty texts have no words and score 0. Words that stand at one place of several
    templates give each its label; repeated documents get the same values. Other columns of docs pass through whatever
    their names; columns of docs that are named like those added would clash and are an error.
    """
    base = [(label, phrase.split()) for label, phrase in BASE]
    rest = [(label, t.split(), [p.split() for p in keys]) for label, t, keys in templates]
    vocabulary = sorted({w for _, ws, _ in rest for w in ws} | {w for _, ws in base for w in ws})
    bodies = docs.select(words_of(text).alias("ws"))
    seen = bodies.select(F.explode(F.array_distinct(F.expr(f"filter(ws, w -> w in ({_quoted(vocabulary)}))"))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in seen.collect()}
    total = max(1, max(df.values(), default=1))
    idf = {w: math.log1p(total / (1 + df.get(w, 0))) for w in vocabulary}

    postings, needs = [], []
    for t, (_, ws) in enumerate(base):
        postings += [(w, t, p, 1) for p, w in enumerate(ws)]
        needs.append(len(ws))
    for t, (_, ws, _) in enumerate(rest, len(base)):
        rare = set(sorted(set(ws), key=lambda w: (-idf[w], w))[:index_words])
        found = [(w, t, p, 0) for p, w in enumerate(ws) if w in rare]
        postings += found
        needs.append(max(2, math.ceil(0.4 * len(found))))
    indexed = sorted({w for w, *_ in postings})
    lists = []  # by kind: the words, and a map from them to their postings
    for kind in (0, 1):
        by_word: dict[str, list[str]] = {}
        for w, t, p, b in postings:
            if b == kind:
                by_word.setdefault(w, []).append(f"named_struct('t', {t}, 'p', {p})")
        lists.append((_quoted(by_word), "map(" + ", ".join(f"'{w}', array({', '.join(ps)})" for w, ps in by_word.items()) + ")"))
    need = "array(" + ", ".join(map(str, needs)) + ")"
    bodies_sql = "array(" + ", ".join(f"array({_quoted(ws)})" for _, ws in [*base, *[(a, b) for a, b, _ in rest]]) + ")"

    def places(ws: list[str], phrase: list[str]) -> list[int]:
        return [i for i in range(len(ws) - len(phrase) + 1) if ws[i : i + len(phrase)] == phrase]

    keys = "array(" + ", ".join(["cast(array() as array<int>)"] * len(base) + ["array(" + ", ".join(str(i + k) for phrase in ks for i in places(ws, phrase)[:1] for k in range(len(phrase))) + ")" for _, ws, ks in rest]) + ")"
    names = f"array({_quoted([a for a, _ in base] + [a for a, _, _ in rest])})"

    # (place, word) of the indexed words; transform(array(x), v -> ...)[0] evaluates x once
    hits = f"""transform(array(ws), v -> transform(filter(transform(v, (w, i) -> if(w in ({_quoted(indexed)}), i, null)), i -> i is not null),
        i -> named_struct('i', i, 'w', v[i])))[0]"""
    aligned = """transform(array(array_sort(flatten(transform(filter(hits, x -> x.w in ({words})), x -> transform({post}[x.w], q -> named_struct('t', q.t, 'o', x.i - q.p)))))),
        c -> filter(c, (x, k) -> get(c, k + {need}[x.t] - 1) = x and not coalesce(get(c, k - 1) = x, false)))[0]"""
    verify = f"""filter(transform(general, x -> transform(array({bodies_sql}[x.t]), b -> named_struct('t', x.t, 'o', x.o,
            'share', size(filter(sequence(0, size(b) - 1), p -> get(ws, x.o + p) = b[p])) / size(b),
            'keys', forall({keys}[x.t], p -> coalesce(get(ws, x.o + p) = b[p], false))))[0]), m -> m.keys and m.share >= {least_match}D)"""
    if taken := set(ADDED) & set(docs.columns):
        raise ValueError(f"the result has columns of its own named {sorted(taken)}")
    out = docs.select(packed(docs).alias("d"), words_of(text).alias("ws")).withColumn("n_words", F.size("ws").cast("long")).withColumn("hits", F.expr(hits))
    none = "cast(array() as array<struct<t:int,o:int>>)"
    out = out.withColumn("found", F.expr(f"if(size(hits) = 0, {none}, {aligned.format(words=lists[1][0], post=lists[1][1], need=need)})"))
    out = out.withColumn("general", F.expr(f"if(size(hits) < 2, {none}, {aligned.format(words=lists[0][0], post=lists[0][1], need=need)})"))
    empty = "cast(array() as array<struct<t:int,o:int,share:double,keys:boolean>>)"
    out = out.withColumn("matches", F.expr(f"if(size(general) = 0, {empty}, {verify})"))
    label = lambda column: f"transform({column}, x -> {names}[x.t])"
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.expr(labels))), ",")
    out = (
        out.withColumn("n_base", F.size("found").cast("long"))
        .withColumn("first_word", F.expr("array_min(transform(found, x -> x.o))").cast("long"))
        .withColumn("last_word", F.expr("array_max(transform(found, x -> x.o))").cast("long"))
        .withColumn("base_labels", joined(label("found")))
        .withColumn("labels", joined(f"concat({label('found')}, {label('matches')})"))
        .withColumn("score", F.expr("if(n_base > 0, 1D, coalesce(array_max(transform(matches, x -> x.share)), 0D))"))
        .withColumn("matches", F.expr(f"transform(matches, x -> named_struct('label', {names}[x.t], 'word', cast(x.o as bigint), 'share', x.share))"))
    )
    return out.select(*unpacked(docs, "d"), *ADDED)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).drop("text", "matches")
