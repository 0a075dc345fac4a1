"""License scans: text blocks that contain a license template, by an exact set-similarity join, beside named phrases.

Tokens are pairs of adjacent words, so that a template's common words alone match nothing. A block is a window of a
text of twice a template's length class (a power of two of at least its pairs), one starting at every multiple of
the class: a stretch as long as the template lies whole in one of them. A block meets a template if it holds
CONTAINMENT of the template's distinct tokens or more.

The join: one narrow pass over the texts keeps the places of template tokens, which are few. Counted over all texts
they give the global order, rarest first. A template's prefix are its rarest tokens, so many that a block without any of them
can't reach the threshold; blocks are joined with the prefixes by equal tokens. The length filter asks a block for
enough template tokens at all; the positional filter drops a match of a token at place i of the template and j of the
block unless the tokens after both still suffice. What is left is counted exactly. No pair that reaches the threshold
is lost.

Nothing is collected by token: a token in a third of all texts is a row for each place, joined with the templates'
prefixes (a parameter, at most MOST_TEMPLATES, sent to every task), and blocks are groups of at most twice the largest class.

Rows: a null text is empty. Documents are told apart by id and text, so equal ids with other texts keep apart and
repeated rows each get the same result; a null id is an id of its own. Other columns are ignored. An empty table gives
an empty result. ``score`` is 1 where a phrase stands, else the greatest containment found, else 0.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, clean_columns, staged, table

WORDS = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
CONTAINMENT = 0.85
MOST_TEMPLATES = 10_000

#: The phrases of the base rule and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Notices and clauses of public licenses and the labels they stand for.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


def _words(text: str) -> list[str]:
    return re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _pairs(text: str) -> list[str]:
    w = _words(text)
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def token_places(docs: DataFrame, tokens: list[str]) -> DataFrame:
    """``doc_id, h, n_words, found``: of each document the places (pair ``at``, counted from 0) of the given tokens; ``h`` are two hashes of its text."""
    text = F.coalesce("text", F.lit(""))
    d = clean_columns(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    h = F.array(F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text")))
    d = d.select("doc_id", h.alias("h"), F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORDS), 1).alias("words"))
    pair = lambda w, i: F.struct(i.alias("at"), F.concat_ws(" ", w, F.get("words", i + 1)).alias("token"))
    found = F.filter(F.transform("words", pair), lambda p: p["token"].isin(tokens))
    return d.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), found.alias("found"))


def _back(k: int):
    return lambda at: at - k


def phrase_starts(phrase: str) -> Column:
    """The words at which the phrase's pairs stand one after another in ``found``."""
    pairs = _pairs(phrase)
    if not pairs:
        raise ValueError("a phrase has two words or more")
    of = lambda t: F.transform(F.filter("found", lambda p: p["token"] == t), lambda p: p["at"])
    starts = of(pairs[0])
    for k, t in enumerate(pairs[1:], 1):
        starts = F.array_intersect(starts, F.transform(of(t), _back(k)))
    return starts


def _class(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def matched(places: DataFrame, templates: list[tuple[str, str]], containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, h, template, containment``: each document's blocks that meet a template, the best one of each template.

    ``template`` is its place in the list. ``places`` (staged) has ``doc_id, h, found``.
    """
    spark = places.sparkSession
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    rows = [(i, sorted(set(_pairs(t))), _class(len(_pairs(t)))) for i, (t, _) in enumerate(templates)]
    if any(not r[1] for r in rows):
        raise ValueError("a template has two words or more")
    rows = [(i, t, len(t), math.ceil(containment * len(t) - 1e-9), c) for i, t, c in rows]
    t = spark.createDataFrame(rows, "template int, tokens array<string>, size int, need int, class int")

    at = places.select("doc_id", "h", F.explode("found").alias("p")).select("doc_id", "h", "p.at", "p.token")
    counts = at.groupBy("token").agg(F.count("*").alias("n"))
    # Global order: rarest first, then by the token itself. At most the templates' tokens are counted.
    order = t.select(F.explode("tokens").alias("token")).distinct().join(counts, "token", "left")
    order = order.select("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token").alias("token")).alias("rank"))
    sets = t.select("template", "size", "need", "class", F.explode("tokens").alias("token")).join(order, "token")
    sets = sets.groupBy("template", "size", "need", "class").agg(F.array_sort(F.collect_list("rank")).alias("set"))
    prefix = sets.select("template", "size", "need", "class", F.col("set").alias("template_set"), F.posexplode("set").alias("i", "rank"))
    prefix = prefix.where(F.col("i") <= F.col("size") - F.col("need"))

    # Each place lies in two blocks of every class.
    classes = F.array(*[F.lit(c) for c in sorted({r[4] for r in rows})])
    at = at.join(F.broadcast(order), "token").select("doc_id", "h", "at", "rank", F.explode(classes).alias("class"))
    last = F.floor(F.col("at") / F.col("class"))
    at = at.select("doc_id", "h", "class", "rank", F.explode(F.array_distinct(F.array(last, F.greatest(last - 1, F.lit(0))))).alias("block"))
    blocks = at.groupBy("doc_id", "h", "class", "block").agg(F.array_sort(F.collect_set("rank")).alias("set"))

    probes = blocks.select("doc_id", "h", "class", "block", "set", F.posexplode("set").alias("j", "rank"))
    left = F.least(F.col("size") - F.col("i"), F.size("set") - F.col("j"))
    pairs = probes.join(F.broadcast(prefix), ["class", "rank"]).where((F.size("set") >= F.col("need")) & (left >= F.col("need")))
    pairs = pairs.select("doc_id", "h", "template", "size", "need", F.size(F.array_intersect("set", "template_set")).alias("common"))
    pairs = pairs.where(F.col("common") >= F.col("need"))
    return pairs.groupBy("doc_id", "h", "template").agg(F.max(F.col("common") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row of ``docs`` (doc_id, text)."""
    tokens = sorted({p for text, _ in [*phrases, *templates] for p in _pairs(text)})
    places = staged(token_places(docs, tokens), "license-places")
    starts = [phrase_starts(p) for p, _ in phrases]
    found = places.select("doc_id", "h", "n_words", *[s.alias(f"s{k}") for k, s in enumerate(starts)])
    every = F.concat(*[F.col(f"s{k}") for k in range(len(phrases))])
    base = F.concat(*[F.when(F.size(f"s{k}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for k, (_, label) in enumerate(phrases)])
    found = found.select("doc_id", "h", "n_words", every.alias("at"), F.array_sort(F.array_distinct(base)).alias("base"))

    labels = F.element_at(F.array(*[F.lit(label) for _, label in templates]), F.col("template") + 1)
    own = matched(places, templates, containment).groupBy("doc_id", "h").agg(F.collect_set(labels).alias("own"), F.max("containment").alias("best"))
    own = own.select(F.col("doc_id").alias("own_id"), F.col("h").alias("own_h"), "own", "best")
    out = found.join(own, found["doc_id"].eqNullSafe(own["own_id"]) & (found["h"] == own["own_h"]), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op12_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
