"""License scans: an exact set-similarity join of license notices with blocks of a text's words (native).

A text meets a notice when some block of half as many words again as the notice, which starts with a word of it, holds at
least the share ``threshold`` of its distinct words, and the words that name the license. All notices' words are put in one
global order, by the number of documents that hold them, the rarest first. Then

* prefix filter: a block that holds enough of a notice's words holds one of its first ``size - need + 1`` in that order, so
  texts without any such word are out;
* length filter: texts with fewer known words of a notice than it needs are out;
* positional filter: of a text's places of a notice's words only those start a block whose next ``need - 1`` such places lie
  within the block.

What is left is counted exactly. The filters leave out nothing that meets a notice, so the result does not depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import set_aside, table

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The single sentences among the notices, and the labels that the method adds.
TEMPLATES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under the gnu general public license version 3": "gpl-3",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
}
THRESHOLD = 0.8
_V2, _V3 = ("version 2", "v 2", "v2", "license 2", "mpl 2", "2 0"), ("version 3", "v 3", "v3", "license 3")
_APACHE, _GPL, _MPL = (("apache",), _V2), (("gnu general public license",), _V3), (("mozilla public license", "mpl"), _V2)
#: Notices with label and what names the license: of each group one phrase.
NOTICES = [(t, label, names) for (t, label), names in zip(TEMPLATES.items(), [(("mit",),), _APACHE, (("cc",), ("nc",)), _GPL, _MPL, (("redistribution",), ("binary",))])] + [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "mit", (("sublicense",), ("granted",)),
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "apache-2", _APACHE,
    ),
    ("apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", "apache-2", _APACHE),
    (
        "creative commons attribution noncommercial 4 0 international public license by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions",
        "cc-by-nc", (("creative commons",), ("noncommercial",)),
    ),
    (
        "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document "
        "but changing it is not allowed",
        "gpl-3", _GPL,
    ),
    (
        "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gpl-3", _GPL,
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "mpl-2", _MPL,
    ),
    ("mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software", "mpl-2", _MPL),
    (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "bsd", (("redistributions",), ("retain",), ("disclaimer",)),
    ),
    ("gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "lgpl", (("gnu lesser general public license",),)),
    ("gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "agpl-3", (("gnu affero general public license",), _V3)),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", "epl-2", (("eclipse public license",), _V2)),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc", (("with or without fee",),)),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", (("unencumbered",), ("public domain",))),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1", (("organization",), ("accompanying",))),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib", (("authors be held liable",),)),
]
#: Anything but letters, digits and characters beyond ASCII.
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of the text with A-Z in lower case.

    ``lower`` also changes letters beyond ASCII, which no phrase or template holds; the one that would become an ASCII
    letter by it, the Kelvin sign, is set aside first.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(low, NOT_A_WORD), "")


def phrase_places(words: str, phrase: str) -> Column:
    """Starts of the phrase in the column ``words``; the array is walked only where all words of the phrase occur."""
    parts = phrase.split()
    n = F.size(words)
    here = F.filter(F.sequence(F.lit(0), n - len(parts)), lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(parts)]))
    return F.when(_all([F.array_contains(words, w) for w in sorted(set(parts), key=len, reverse=True)]) & (n >= len(parts)), here).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def least_overlap(size: int, threshold: float) -> int:
    """The least number of shared words that makes the share reach the threshold."""
    return next(k for k in range(size + 1) if k / size >= threshold)


def word_counts(words: DataFrame, column: str, vocabulary: list[str]) -> dict[str, int]:
    """Of each word of the vocabulary the number of rows that hold it, over all rows. What the driver gets has the vocabulary's size."""
    held = words.select(F.explode(F.array_intersect(column, F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def _lists(values) -> Column:
    return F.array(*map(F.lit, values))


def prepared(notices: list[tuple], counts: dict[str, int], threshold: float) -> tuple[Column, list[str]]:
    """The notices as an array of structs, their words in the global order, and all prefix words."""
    rows, first = [], set()
    for text, label, names in notices:
        own = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
        need = least_overlap(len(own), threshold)
        prefix = own[: len(own) - need + 1]
        first |= set(prefix)
        fields = {"label": F.lit(label), "words": _lists(own), "prefix": _lists(prefix), "need": F.lit(need), "block": F.lit(len(text.split()) * 3 // 2), "names": F.array(*[_lists(g) for g in names])}
        rows.append(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return F.array(*rows), sorted(first)


def best_share(words: str, notice: Column) -> Column:
    """The best share of the notice in a block of ``words`` that meets it, else NULL."""
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(notice["words"], F.get(words, i)))

    def starts(at: Column) -> Column:
        return F.filter(at, lambda p, k: F.get(at, k + notice["need"] - 1) < p + notice["block"])

    def block(s: Column) -> Column:
        held = F.slice(words, s + 1, notice["block"])
        return F.struct(F.size(F.array_intersect(notice["words"], held)).alias("n"), F.concat(F.lit(" "), F.array_join(held, " "), F.lit(" ")).alias("text"))

    def meets(b: Column) -> Column:
        named = F.forall(notice["names"], lambda group: F.exists(group, lambda phrase: F.contains(b["text"], F.concat(F.lit(" "), phrase, F.lit(" ")))))
        return (b["n"] >= notice["need"]) & named

    # the places are bound by a transform of one element, so that they are looked up once
    found = F.flatten(F.transform(F.array(places), lambda at: F.filter(F.transform(starts(at), block), meets)))
    return F.array_max(F.transform(found, lambda b: b["n"])) / F.size(notice["words"])


def scan(docs: DataFrame, text: str = "text", notices: list[tuple] = NOTICES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score, which replace columns of these names; all others stay.

    ``notices`` are (text, label, naming phrases). Null and empty texts have no words; labels are distinct, sorted and joined
    with commas, empty where there is none; the score is the best share of a notice that some block meets, 0 where none
    does. Texts of any length are read whole; rows alike in text have the same result, and every row is kept.
    """
    vocabulary = sorted({w for t, *_ in notices for w in t.split()})
    docs, names, back = set_aside(docs)
    text = names.get(text, text)
    rows = docs.withColumn("_words", words_of(F.col(text)))
    known, first = prepared(notices, word_counts(rows, "_words", vocabulary), threshold)
    least = min(least_overlap(len(set(t.split())), threshold) for t, *_ in notices)
    rows = rows.withColumns({"_known": F.array_intersect("_words", _lists(vocabulary)), "_places": F.array(*[phrase_places("_words", p) for p in phrases])})
    near = F.filter(known, lambda t: F.arrays_overlap(t["prefix"], F.col("_known")) & (F.size(F.array_intersect(t["words"], F.col("_known"))) >= t["need"]))
    rows = rows.withColumn("_near", F.when((F.size("_known") >= least) & F.arrays_overlap("_known", _lists(first)), near))
    shares = F.transform("_near", lambda t: F.struct(t["label"].alias("label"), best_share("_words", t).alias("score")))
    rows = rows.withColumn("_found", F.when(F.size("_near") > 0, F.filter(shares, lambda x: x["score"].isNotNull())))
    rows = rows.withColumns({"_all": F.flatten("_places"), "_named": F.filter(F.array(*[F.when(F.size(F.get("_places", k)) > 0, F.lit(x)) for k, x in enumerate(phrases.values())]), lambda x: x.isNotNull())})
    added = F.coalesce(F.transform("_found", lambda x: x["label"]), F.array().cast("array<string>"))
    out = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_base": F.size("_all").cast("long"),
            "first_word": F.array_min("_all").cast("long"),
            "last_word": F.array_max("_all").cast("long"),
            "base_labels": F.array_join(F.array_sort(F.array_distinct("_named")), ","),
            "labels": F.array_join(F.array_sort(F.array_union("_named", added)), ","),
            "score": F.coalesce(F.array_max(F.transform("_found", lambda x: x["score"])), F.lit(0.0)),
        }
    )
    return back(out.drop("_words", "_known", "_places", "_near", "_found", "_all", "_named"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql() -> str:
    cases = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, i - 1 AS place FROM d, LATERAL (SELECT unnest(range(1, len(w) - {len(p.split()) - 2})) AS i) WHERE "
        + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
        for p, label in PHRASES.items()
    )
    lists = ", ".join(f"({sorted(set(t.split()))}, '{label}', {least_overlap(len(set(t.split())), THRESHOLD)}, {len(t.split()) * 3 // 2}, {[list(g) for g in names]})" for t, label, names in NOTICES)
    return f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
), base AS ({cases}),
named AS (SELECT r, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
templates(words, label, need, block, names) AS (VALUES {lists}),
near AS (SELECT r, w, t.* FROM d, templates t WHERE len(list_intersect(words, w)) >= need),
blocks AS (SELECT r, label, words, need, names, w[s : s + block - 1] AS b FROM near, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS s) WHERE list_contains(words, w[s])),
met AS (
    SELECT r, label, len(list_intersect(words, b))::DOUBLE / len(words) AS share FROM blocks
    WHERE len(list_intersect(words, b)) >= need
      AND len(list_filter(names, lambda g: len(list_filter(g, lambda p: contains(' ' || array_to_string(b, ' ') || ' ', ' ' || p || ' '))) = 0)) = 0
),
scores AS (SELECT r, max(share) AS score FROM met GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION SELECT r, label FROM met) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN named USING (r) LEFT JOIN scores USING (r) LEFT JOIN every USING (r)
"""


OP9_SQL = _sql()
