"""Licence scan with a positional rare-token index, in DataFrame operations only.

Texts become strings of words with one space between them. Only texts that hold a few licence words go on; the others
are done with their counts. Licence words are ordered by the number of documents that hold them, over all rows. A text
looks up the postings (template, position) of its rare words alone: where half of the words must agree, one of the
rarer half or the next one does. Each match is a template at a relative position, and only there the template's other
words are compared with the text's. A template is accepted when enough of its own words agree at one relative position
and its mandatory phrases stand in the text. The order decides what is looked up and never what is found, so a text's
labels depend on no other notice in it and on no other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import spill, table

#: The share of a template's words that must agree on a relative position.
AGREE = 0.5
#: Different licence words that a text must hold to be looked up, and places of a template that must agree.
LEAST = 3

# The base phrases with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Fixed values: (label, notice, mandatory phrases), from the public licence texts, in words as this module reads them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", ("gnu general public license", "free software")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
)
# Words of the templates that any text may hold, which don't count when words are compared.
COMMON = frozenset("a all and any are as at be by can code copy either event except file for form forms if in is it may met no not of one or out program provided public that the this to under use used version with without work you above following made obtain purpose person free held terms available subject fee sell 0 2 4 v".split())


def vocabulary() -> list[str]:
    """The template words that count, the licence words. Which of them are rare, the documents say."""
    return sorted({w for _, notice, _ in TEMPLATES for w in notice.split()} - COMMON)


def rarest_first(terms: DataFrame) -> list[str]:
    """The licence words by the number of rows of (terms) that hold them, equally frequent ones by the word.

    ``terms`` has the different licence words of every document; the driver gets a row per licence word.
    """
    held = {r["word"]: r["n"] for r in terms.select(F.explode("terms").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary(), key=lambda word: (held.get(word, 0), word))


def normalised(text: Column) -> Column:
    """The words of a text with one space between them; lower-casing beyond ASCII changes no word boundary. The sign of
    the kelvin is the one that would become an ASCII letter by itself, and stays apart."""
    plain = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u00e5"))
    return F.trim(F.regexp_replace(F.lower(plain), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _literal(rows: list[tuple], names: str, spark: SparkSession) -> DataFrame:
    """A small fixed table as a plan of literals."""
    return spark.range(1).select(F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names.split(), strict=True))) for r in rows))).alias("r")).select("r.*")


def base_places(padded: Column) -> dict[str, Column]:
    """Number of places, first and last word and labels of the base phrases in a text with a space at both ends."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        found = F.contains(padded, F.lit(f" {phrase} "))
        count = F.regexp_count(padded, F.lit(f" {phrase}(?= )"))
        first = _spaces(F.substr(padded, F.lit(1), F.instr(padded, f" {phrase} "))) - 1
        back = F.instr(F.reverse(padded), f" {phrase} "[::-1]) + len(phrase) + 1  # of the space before its last place
        last = _spaces(F.substr(padded, F.lit(1), F.char_length(padded) + 1 - back)) - 1
        counts.append(F.when(found, count).otherwise(0))
        firsts.append(F.when(found, first))
        lasts.append(F.when(found, last))
        labels.append(F.when(found, F.lit(label)))
    return {
        "n_base": sum(counts[1:], counts[0]).cast("long"),
        "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"),
        "base_labels": F.array_compact(F.array(*labels)),
    }


def _places(texts: DataFrame) -> DataFrame:
    """The places of the licence words in each text, beside its other columns."""
    rest = [c for c in texts.columns if c != "words"]
    return texts.select(*rest, F.posexplode(F.split("words", " ")).alias("pos", "word")).where(F.col("word").isin(vocabulary()))


def looked_up(texts: DataFrame, ranked: list[str]) -> DataFrame:
    """(key, template, at, label, size, asked): where templates may stand in the texts (key, words), by their rare words.

    ``ranked`` has the licence words, the rarest first. ``size`` and ``asked`` are the numbers of different licence words
    of the template and the text. Of the smaller number the share ``AGREE`` must agree, so the rarest word that does has
    the others behind it among the words of both; words with fewer behind them aren't looked up.
    """
    spark = texts.sparkSession
    held = F.array_intersect(F.array(*(F.lit(w) for w in ranked)), F.split("words", " "))
    places = _places(texts.withColumn("held", held)).withColumn("asked", F.size("held")).withColumn("nth_asked", F.array_position("held", F.col("word")))
    index = F.broadcast(_literal(_index(ranked), "word template label size nth place", spark))
    agree = AGREE * F.least("asked", "size")
    found = places.join(index, "word").where((F.col("nth") - 1 <= F.col("size") - agree) & (F.col("nth_asked") - 1 <= F.col("asked") - agree))
    return found.select("key", "template", (F.col("pos") - F.col("place")).alias("at"), "label", "size", "asked").distinct()


def template_matches(texts: DataFrame, ranked: list[str]) -> DataFrame:
    """(key, found, share): labels of the templates that stand in each text (key, words), and the best share of agreeing words.

    The share is of the template's words, or of the text's licence words where it has fewer. ``ranked`` as in ``looked_up``.
    """
    notice = F.broadcast(_literal(_postings(), "word template place", texts.sparkSession))
    wanted = looked_up(texts, ranked).join(notice, "template").withColumn("pos", F.col("at") + F.col("place"))
    vote = wanted.join(_places(texts), ["key", "pos", "word"]).groupBy("key", "template", "at", "label", "size", "asked").agg(F.count("*").alias("votes"), F.countDistinct("word").alias("voters"))
    best = vote.withColumn("share", F.col("voters") / F.least("asked", "size")).where(f"votes >= {LEAST} and share >= {AGREE}")
    best = best.groupBy("key", "template", "label").agg(F.max("share").alias("share"))
    padded = F.concat(F.lit(" "), "words", F.lit(" "))
    must = F.lit(False)
    for t, (_, _, phrases) in enumerate(TEMPLATES):
        stands = F.lit(True)
        for phrase in phrases:
            stands = stands & F.contains(padded, F.lit(f" {phrase} "))
        must = must | ((F.col("template") == t) & stands)
    return best.join(texts, "key").where(must).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))


def _postings() -> list[tuple[str, int, int]]:
    words = set(vocabulary())
    return [(w, t, p) for t, (_, notice, _) in enumerate(TEMPLATES) for p, w in enumerate(notice.split()) if w in words]


def _sizes() -> list[tuple[int, str, int]]:
    words = set(vocabulary())
    return [(t, label, len(words & set(notice.split()))) for t, (label, notice, _) in enumerate(TEMPLATES)]


def _index(ranked: list[str]) -> list[tuple[str, int, str, int, int, int]]:
    """The postings with the label and size of their template and the word's place among its words, the rarest first (from 1)."""
    order = [[w for w in ranked if w in notice.split()] for _, notice, _ in TEMPLATES]
    return [(w, t, TEMPLATES[t][0], len(order[t]), order[t].index(w) + 1, place) for w, t, place in _postings()]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    ``n_base`` counts the places where a base phrase's words stand one after the other, ``first_word`` and
    ``last_word`` are the smallest and largest place (null without one). ``labels`` adds those of the templates.
    The score is 1 with a base phrase, else the best share of a template's words that agree, else 0. Null
    and empty texts have no words and no label. Rows may repeat or lack an id; an empty table gives no rows; other
    columns don't matter.
    """
    words = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("words"))
    padded = F.concat(F.lit(" "), F.col("words"), F.lit(" "))
    may = F.lit(False)
    for phrase, _ in PHRASES:
        may = may | F.contains(padded, F.lit(f" {phrase} "))
    terms = F.array_intersect(F.split("words", " "), F.array(*(F.lit(w) for w in vocabulary())))
    # one scan of the documents: their counts and licence words, and all words of the few texts that are looked up
    counted = words.withColumn("terms", terms).select(
        "id",
        F.when(F.col("words") == "", 0).otherwise(_spaces(F.col("words")) + 1).cast("long").alias("n_words"),
        F.when(may, F.struct(*(c.alias(n) for n, c in base_places(padded).items()))).alias("base"),
        F.when(F.size("terms") >= LEAST, F.col("words")).alias("words"),
        "terms",
    )
    counted = spill(counted, "license-words").withColumn("key", F.sha2("words", 256))
    some = counted.where("words is not null")
    found = template_matches(some.select("key", "words").distinct(), rarest_first(counted.select("terms")))
    rest = counted.where("words is null").select("id", "n_words", "base", F.lit(None).cast("array<string>").alias("found"), F.lit(None).cast("double").alias("share"))
    out = some.join(found, "key", "left").select("id", "n_words", "base", "found", "share").unionAll(rest)
    none = F.array().cast("array<string>")
    base_labels = F.coalesce("base.base_labels", none)
    n_base = F.coalesce("base.n_base", F.lit(0)).cast("long")
    return out.select(
        "id",
        "n_words",
        n_base.alias("n_base"),
        F.col("base.first_word").alias("first_word"),
        F.col("base.last_word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("found", none))), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).cast("double").alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of every row of ``documents``."""
    return license_scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def oracle_sql() -> str:
    """The same scan over lists of words, for DuckDB."""
    places = " UNION ALL ".join(
        f"SELECT row, '{label}' AS label, i - 1 AS place FROM (SELECT row, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM d) WHERE w[i:i + {n - 1}] = {phrase.split()}"
        for phrase, label in PHRASES
        for n in [len(phrase.split())]
    )
    must = " OR ".join(f"(template = {t} AND " + " AND ".join(f"contains(' ' || array_to_string(w, ' ') || ' ', ' {p} ')" for p in phrases) + ")" for t, (_, _, phrases) in enumerate(TEMPLATES))
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
places AS ({places}),
base AS (SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY row),
lic(word) AS (VALUES {_values([(w,) for w in vocabulary()])}),
texts AS (SELECT array_to_string(w, ' ') AS key, any_value(w) AS w FROM d GROUP BY 1),
hits AS (SELECT key, w[i] AS word, i - 1 AS pos FROM (SELECT key, w, unnest(generate_series(1, len(w))) AS i FROM texts) WHERE w[i] IN (SELECT word FROM lic)),
held AS (SELECT key FROM hits GROUP BY key HAVING count(DISTINCT word) >= {LEAST}),
hit AS (SELECT * FROM hits WHERE key IN (SELECT key FROM held)),
looked AS (SELECT key, word, pos FROM hit),
postings(word, template, place) AS (VALUES {_values(_postings())}),
sizes(template, label, size) AS (VALUES {_values(_sizes())}),
vote AS (SELECT key, template, pos - place AS at, count(*) AS votes, count(DISTINCT word) AS voters FROM looked JOIN postings USING (word) GROUP BY ALL),
asked AS (SELECT key, count(DISTINCT word) AS asked FROM looked GROUP BY key),
best AS (SELECT key, template, label, CAST(voters AS DOUBLE) / least(asked, size) AS share FROM vote JOIN asked USING (key) JOIN sizes USING (template) WHERE votes >= {LEAST}),
sure AS (SELECT key, list(DISTINCT label) AS labels, max(share) AS share FROM best JOIN texts USING (key) WHERE share >= {AGREE} AND ({must}) GROUP BY key)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(sure.labels, [])))), ','), '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (row) LEFT JOIN sure ON sure.key = array_to_string(d.w, ' ')"""
