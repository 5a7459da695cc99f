from __future__ import annotations

import random
from collections import Counter

import pytest

from bitquarry.llm import licenses

from .brute import words


def scan(spark, rows, schema="doc_id long, text string"):
    return {r["id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, schema)).collect()}


def base(text):
    w = [x.decode() for x in words(text)]
    found = [(i, label) for phrase, label in licenses.PHRASES for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    places = [i for i, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    None, "", "...", "cc by cc by cc-by-cc by", "MIT License", "The MIT license, and the mit LICENSE; GNU General Public License.", "ccby gnu general public", "x " * 20_000 + "Apache License 2 mit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "words before. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: more",
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "déjà İ K vu cc by é", "software permission granted hereby free", "licensed under the Apache License, Version 2.0",
]


def test_base_matches_brute_force_and_templates_add_labels(spark):
    got = scan(spark, list(enumerate(TEXTS)))
    for k, text in enumerate(TEXTS):
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) >= (r["n_base"] > 0)
    assert got[8]["labels"] == "mit" and got[9]["labels"] == "bsd" and got[11]["labels"] == "cc-by,cc-by-nc" and got[13]["labels"] == ""
    assert got[14]["labels"] == "apache,apache-2.0"


def test_notices_do_not_crowd_each_other_out(spark):
    full = {label: notice for label, notice, _ in reversed(licenses.TEMPLATES)}  # the first notice of each label
    rows = [["mit", "zlib"], ["mit", "bsd", "apache-2.0"], ["mit", "bsd", "zlib", "isc"], list(full)]
    got = scan(spark, [(k, " and some words between them ".join(full[label] for label in labels)) for k, labels in enumerate(rows)])
    for k, labels in enumerate(rows):
        assert set(labels) <= set(got[k]["labels"].split(",")), labels
        assert got[k]["score"] == 1


def test_other_rows_do_not_change_a_text_s_labels(spark):
    full = {label: notice for label, notice, _ in licenses.TEMPLATES}
    mit = next(notice for label, notice, _ in licenses.TEMPLATES if label == "mit")
    text, few = mit + " and " + full["zlib"], "a warranty and the authors"  # few: too few licence words to be looked up
    for others in ([], [full["zlib"] + f" {k}" for k in range(9)], [mit + f" {k}" for k in range(9)], [few + f" {k}" for k in range(9)]):
        got = scan(spark, [(0, text), *((k + 1, t) for k, t in enumerate(others))])
        assert (got[0]["labels"], got[0]["score"]) == ("mit,zlib", 1)


def every_vote(text):
    """Labels and best share when every licence word of the text is compared with every place of every template."""
    w, lic = text.split(), set(licenses.vocabulary())
    asked, labels, best = len(lic & set(w)), set(), 0.0
    for label, notice, phrases in licenses.TEMPLATES:
        n = notice.split()
        for at in range(-len(n), len(w)):
            agree = [x for p, x in enumerate(n) if x in lic and 0 <= at + p < len(w) and w[at + p] == x]
            share = len(set(agree)) / max(1, min(asked, len(lic & set(n))))
            if asked >= licenses.LEAST and len(agree) >= licenses.LEAST and share >= licenses.AGREE and all(f" {p} " in f" {text} " for p in phrases):
                labels.add(label)
                best = max(best, share)
    return labels, best


def parts_of_notices(seed):
    """Texts of whole and broken notices with licence words between them."""
    rng, lic, texts = random.Random(seed), licenses.vocabulary(), []
    for _ in range(60):
        text = []
        for _, notice, phrases in rng.choices(licenses.TEMPLATES, k=rng.randint(1, 3)):
            held = {x for p in phrases for x in p.split()}
            text += [rng.choice([*lic, "and"]) for _ in range(rng.randint(0, 4))]
            loss = rng.choice([0, 0.3, 0.6, 0.9])
            text += [x if x in held or rng.random() >= loss else rng.choice(["some", "words", rng.choice(lic)]) for x in notice.split()]
        texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_rare_words_find_what_all_words_find(spark, seed):
    texts, order = parts_of_notices(seed), licenses.vocabulary()
    random.Random(seed).shuffle(order)
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "key string, words string")
    for ranked in (order, order[::-1]):
        got = {int(r["key"]): (set(r["found"]), r["share"]) for r in licenses.template_matches(df, ranked).collect()}
        for k, text in enumerate(texts):
            assert got.get(k, (set(), 0.0)) == every_vote(text), text
    assert len({x for t in texts for x in every_vote(t)[0]}) > 9 and not all(every_vote(t)[0] for t in texts)


def test_only_rare_words_are_looked_up(spark):
    t, (_, notice, _) = next((t, x) for t, x in enumerate(licenses.TEMPLATES) if x[0] == "zlib")
    own = [w for w in licenses.vocabulary() if w in notice.split()]
    rest = [w for w in licenses.vocabulary() if w not in own]
    half = len(own) // 2
    df = spark.createDataFrame([("few", " ".join([*own[half + 1 :], *rest])), ("one", " ".join([own[half], *rest]))], "key string, words string")
    for ranked, keys in ((own + rest, {"one"}), (own[::-1] + rest, {"few", "one"})):
        assert {r["key"] for r in licenses.looked_up(df, ranked).where(f"template = {t}").collect()} == keys


def test_rarity_is_that_of_all_documents(spark, monkeypatch):
    asked = []
    matches = licenses.template_matches
    monkeypatch.setattr(licenses, "template_matches", lambda texts, ranked: asked.append(ranked) or matches(texts, ranked))
    rows = [next(notice for label, notice, _ in licenses.TEMPLATES if label == "mit"), "Software, software", "software", "a warranty", "warranty and software", "warranty", None, ""]
    scan(spark, list(enumerate(rows)))
    held = Counter(w for t in rows if t for w in {x.decode() for x in words(t)} & set(licenses.vocabulary()))
    assert asked == [sorted(licenses.vocabulary(), key=lambda w: (held[w], w))] and asked[0][-2:] == ["warranty", "software"]


def test_edge_cases(spark):
    assert scan(spark, []) == {}
    rows = [(1, "mit license", "k", 3), (1, "mit license", "k", 4), (None, "bsd", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, words int")
    assert sorted(((r["id"], r["labels"]) for r in licenses.license_scan(docs).collect()), key=str) == [(1, "mit"), (1, "mit"), (None, "")]


def test_no_python_in_the_plan(spark):
    plan = licenses.license_scan(spark.createDataFrame([(1, "x")], "doc_id long, text string").cache())._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_matches_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, t) for k, t in enumerate(TEXTS) if t is None or ("İ" not in t and "K" not in t)]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cursor = connection.execute(licenses.oracle_sql())
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    got = sorted(tuple(r["id" if n == "doc_id" else n] for n in names) for r in scan(spark, rows).values())
    assert got == want
