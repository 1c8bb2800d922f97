"""Licence scan with a positional index of rare licence words, in DataFrame functions only.

The index holds, for every licence word, the templates and places it stands in. For each template, the RARE licence
words of highest inverse document frequency (counted over all files) that a file has are looked up: every place of
such a word says where the template would begin, and beginnings that AGREE different rare words share are proposals.
Ranking is per template, so that one licence's words don't crowd out another's in the same file. Then all words of
the template that stand at their relative places to a proposal are added up, weighted by their frequencies; it is
likely where they make up LEAST_SHARE of the template's weight. At last the template's key phrases are verified: each
must stand, whole, within SLACK words of its own place, so words put in between two phrases do no harm.

Files that lack a word of a template's key phrases are not looked up for it: they could not be verified.
Besides, the plain names of licences (BASE) are looked for as consecutive words, at all places.

Score: the largest share of a found template; a plain name alone counts LEAST_SHARE.

What is shuffled are the licence words, with places and templates, of files that hold all words of a template's key
phrases; the joins of proposals are Spark's, broadcast only below its threshold and else shuffled by file, template
and place. Defined cases: a null text is empty and finds nothing (n_words 0, null places, empty labels,
score 0); repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_SHARE, SLACK = 0.5, 8
RARE, AGREE = 8, 2

# Names of licences and the labels they give.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, opening of the licence or of its usual notice, and phrases that must be there.
TEMPLATES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("hereby granted free", "associated documentation files")),
    ("mit-notice", "released under the mit license", ("mit license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0-text", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("applicable law", "without warranties")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("binary forms", "following conditions")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("hereby granted",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)

# Words of templates that say nothing about a licence.
COMMON = set("a all an and any are as can for has in into is it of on or that the this to use with you".split())


def _index():
    """Licence words, and for each its (template, place) pairs."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, (_, text, _) in enumerate(TEMPLATES):
        for place, word in enumerate(text.split()):
            if word not in COMMON:
                postings.setdefault(word, []).append((t, place))
    words = set(postings) | {w for phrase in BASE for w in phrase.split()} | {w for _, _, keys in TEMPLATES for k in keys for w in k.split()}
    return sorted(words), postings


def _starts(hits: Column, phrase: str) -> Column:
    """All places where the words of a phrase stand consecutively: its words' places, shifted and intersected."""
    def shifted(i: int, word: str) -> Column:
        return F.transform(F.filter(hits, lambda h: h.w == word), lambda h: h.p - F.lit(i))

    return reduce(F.array_intersect, [shifted(i, word) for i, word in enumerate(phrase.split())])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    vocabulary, postings = _index()
    words = df.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(lower_ascii(F.coalesce(text_col, F.lit(""))), F.lit(WORD), F.lit(0)).alias("words"))
    placed = F.transform("words", lambda w, i: F.struct(i.alias("p"), w.alias("w")))
    files = stored(
        words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(placed, lambda h: h.w.isin(vocabulary)).alias("hits"))
        .withColumn("row", F.monotonically_increasing_id()),
        "licence-words",
    )
    # document frequencies: at most one row for each licence word
    counted = files.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h.w))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    total, seen = files.count(), {r.w: r.n for r in counted}
    idf = {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 1e-6 for w in vocabulary}
    idf_of = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, idf[w])])
    places_of = F.create_map(*[x for w, ps in postings.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("place")) for t, p in ps]))])
    weight = [sum(idf[w] for w in text.split() if w not in COMMON) for _, text, _ in TEMPLATES]

    has = F.array_distinct(F.transform("hits", lambda h: h.w))
    by_rarity = [sorted({w for w in text.split() if w not in COMMON}, key=lambda w: (-idf[w], w)) for _, text, _ in TEMPLATES]

    def rare(t: int) -> Column:
        """The template's rarest words in the file, if it has all words of its key phrases."""
        there = reduce(lambda a, b: a & b, [F.array_contains("has", w) for w in sorted({w for key in TEMPLATES[t][2] for w in key.split()})])
        words_of = F.filter(F.array(*[F.lit(w) for w in by_rarity[t]]), lambda w: F.array_contains("has", w))
        return F.when(there, F.slice(words_of, 1, RARE)).otherwise(F.array().cast("array<string>"))

    looked_for = F.array(*[F.struct(F.lit(t).alias("t"), rare(t).alias("rare")) for t in range(len(TEMPLATES))])
    keyed = files.filter(F.size("hits") > 0).select("row", "hits", has.alias("has")).select("row", "hits", F.filter(looked_for, lambda c: F.size(c.rare) > 0).alias("looked_for"))
    keyed = stored(keyed.filter(F.size("looked_for") > 0), "licence-files")
    # every licence word of these files at every place that it has in a template looked for
    at_places = keyed.select("row", "looked_for", F.explode("hits").alias("h")).select("row", "looked_for", "h.p", "h.w", F.explode(places_of[F.col("h.w")]).alias("at"))
    rare_of = F.get(F.filter("looked_for", lambda c: c.t == F.col("at.t")), F.lit(0))["rare"]
    begins = at_places.select("row", F.col("at.t").alias("t"), (F.col("p") - F.col("at.place")).alias("begin"), "w", rare_of.alias("rare")).filter(F.col("rare").isNotNull())
    proposed = begins.filter(F.array_contains("rare", F.col("w"))).groupBy("row", "t", "begin").agg(F.count_distinct("w").alias("n")).filter(F.col("n") >= AGREE).select("row", "t", "begin")
    agreed = begins.select("row", "t", "begin", "w").join(proposed, ["row", "t", "begin"], "left_semi").groupBy("row", "t", "begin").agg(F.sum(idf_of[F.col("w")]).alias("found"))
    share = F.col("found") / F.array(*[F.lit(w) for w in weight])[F.col("t")]
    likely = agreed.withColumn("share", F.least(F.lit(1.0), share)).filter(F.col("share") >= LEAST_SHARE)

    def near(phrase: str, place: int) -> Column:
        """Beginnings from which a place of the phrase is no farther than SLACK from its own."""
        return F.flatten(F.transform(_starts(F.col("hits"), phrase), lambda s: F.sequence(s - F.lit(place + SLACK), s - F.lit(place - SLACK))))

    def verified(t: int) -> Column:
        """The largest share of a likely place of the template with all of its key phrases near; null without one."""
        text = TEMPLATES[t][1].split()
        places = [next(i for i in range(len(text)) if text[i : i + len(k)] == k) for k in (key.split() for key in TEMPLATES[t][2])]
        mine = F.filter("likely", lambda c: c.t == t)
        whole = reduce(F.array_intersect, [near(key, place) for key, place in zip(TEMPLATES[t][2], places, strict=True)], F.transform(mine, lambda c: c.begin))
        # shares of the places that were verified: (begin, share) pairs by begin, as a map
        shares = F.map_from_entries(F.transform(mine, lambda c: F.struct(c.begin, c.share)))
        return F.when(F.size(mine) > 0, F.array_max(F.transform(whole, lambda b: shares[b])))

    by_file = likely.groupBy("row").agg(F.collect_list(F.struct("t", "begin", "share")).alias("likely"))
    proven = keyed.select("row", "hits").join(by_file, "row").select("row", F.array(*[F.struct(F.lit(t).alias("t"), verified(t).alias("share")) for t in range(len(TEMPLATES))]).alias("v"))
    likely = proven.select("row", F.inline(F.filter("v", lambda c: c.share.isNotNull())))
    labels = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    found = likely.groupBy("row").agg(F.collect_set(labels[F.col("t")]).alias("more"), F.max("share").alias("share"))

    base = files.select("row", "doc_id", "n_words", *[_starts(F.col("hits"), phrase).alias(label) for phrase, label in BASE.items()])
    named = [F.col(f"`{label}`") for label in BASE.values()]
    base_labels = F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(named, BASE.values(), strict=True)]), lambda x: x.isNotNull())
    starts = F.concat(*named)
    told = base.select("row", "doc_id", "n_words", starts.alias("starts"), base_labels.alias("base"))
    out = told.join(found, "row", "left")
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    n_base = F.size("starts").cast("long")
    return out.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        text(F.col("base")).alias("base_labels"), text(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(n_base > 0, F.lit(LEAST_SHARE)).otherwise(F.lit(0.0))).alias("score"),
    )
