from __future__ import annotations

import math
import random
import unicodedata
import zlib

import numpy as np
import pytest

from bitquarry.llm import toxicity as tx

DOCS = "doc_id long, text string, lang string"


SHAPES = {k: tx.Shapes(k) for k in (1, 2)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_measures_edits():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(2))
        for k in (1, 2):
            automaton = tx.Levenshtein(a, SHAPES[k])
            state = automaton.start()
            for char in b:
                state = state and automaton.step(state, char)
            d = automaton.distance(state) if state else None
            assert (d if d is not None else k + 1) == min(edits(a, b), k + 1), (a, b)


def test_lookup_matches_all_terms():
    rng = random.Random(2)
    terms = {"".join(rng.choice("abé") for _ in range(rng.randrange(3, 9))) + rng.choice(["", "*"]): 1.0 for _ in range(25)}
    lexicon = tx.Lexicon(terms)
    for _ in range(4000):
        word = "".join(rng.choice("abéc") for _ in range(rng.randrange(1, 10)))
        near = []
        for t in terms:
            body = t.rstrip("*")
            if len(body) >= (6 if t.endswith("*") else 5):
                near.append(min(edits(body, word[:n]) for n in (range(len(word) + 1) if t.endswith("*") else [len(word)])))
        exact = word in terms or any(t.endswith("*") and word.startswith(t[:-1]) for t in terms)
        got = lexicon.lookup(word)
        assert (got is not None) == (exact or min(near, default=9) <= 1), word
        assert got is None or got[1] == (0 if exact else 1)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    bad, stem = ["grubnork", "flimwit", "snagdolt"], "zorbel"
    rows, labels = [], []
    for d in range(1200):
        toxic = d % 6 == 0
        w = [f"{rng.choice('abcdefgh')}{rng.choice('xyz')}{rng.randrange(60)}" for _ in range(rng.randrange(20, 90))]
        if toxic:
            for _ in range(3):
                term = rng.choice([*bad, stem + rng.choice(["ing", "s", "ka"])])
                if rng.random() < 0.2:
                    term = term[:3] + term[4:]
                w.insert(rng.randrange(len(w)), rng.choice([term, term.upper()]))
        rows.append((d, " ".join(w), "xx"))
        labels.append((d, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, corpus):
    rows, labels = corpus
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.fit(docs, known)
    assert all(any(w.startswith(t.rstrip("*")) for t in model.terms) for w in ("grubnork", "flimwit", "snagdolt", "zorbel"))
    truth = dict(labels)
    out = tx.toxicity(docs, model).select("id", "score", tx.held_out("id").alias("held")).collect()
    assert {r["id"] for r in out if r["held"]} == {d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    right = [(r["score"] >= 0.5) == truth[r["id"]] for r in out if r["held"]]
    assert np.mean(right) > 0.97
    kept = tx.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["id"] for r in out if r["score"] < 0.5}


def test_labels_of_held_out_rows_do_not_matter(spark, corpus):
    rows, labels = corpus
    other = [(d, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, t in labels]
    docs = spark.createDataFrame(rows, DOCS)
    one, two = (tx.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, other))
    assert one.terms == two.terms and np.allclose(one.factor, two.factor)


def test_quotation_counts_apart_from_abuse():
    lexicon = tx.Lexicon({"moron": 5.0})
    at = tx.FEATURES.index
    quoted = tx.features('they chanted "moron" loudly', lexicon)
    direct = tx.features("you are such a moron really", lexicon)
    assert quoted[at("quoted density")] > 0 == quoted[at("address density")]
    assert direct[at("address density")] > 0 == direct[at("quoted density")]


def plain_words(text):
    """(start, word) of a lower-cased text, character by character."""
    out, run = [], ""
    for k, c in enumerate(text + " "):
        if c in "0123456789abcdefghijklmnopqrstuvwxyz" or c > "\x7f" and (c.isalnum() or unicodedata.category(c).startswith("M")):
            run += c
            continue
        at = k - len(run)
        spaced = ""
        for i, x in enumerate(run):
            if "ก" <= x <= "๛" or "぀" <= x <= "ヿ" or "一" <= x <= "鿿":
                if spaced:
                    out.append((at + i - len(spaced), spaced))
                    spaced = ""
                rest = run[i:]
                end = next((j for j, y in enumerate(rest) if not ("ก" <= y <= "๛" or "぀" <= y <= "ヿ" or "一" <= y <= "鿿")), len(rest))
                out.append((at + i, rest[: min(end, 8)]))
            else:
                spaced += x
        if spaced:
            out.append((at + len(run) - len(spaced), spaced))
        run = ""
    return out


def plain_quotations(text):
    """Character ranges between marks that belong together."""
    out, base = [], 0
    for line in text.split("\n"):
        for pairs in ([('"', '"')], [("“", "”"), ("„", "“"), ("„", "”")], [("«", "»"), ("»", "«")], [("‹", "›"), ("›", "‹")]):
            begun = None
            for k, c in enumerate(line):
                if begun and (line[begun[0]], c) in pairs:
                    out.append((base + begun[0], base + k))
                    begun = None
                elif any(c == a for a, _ in pairs):
                    begun = (k,)
        base += len(line) + 1
    return out


def plain_features(text, terms):
    text = (text or "").lower()
    words, spans = plain_words(text), plain_quotations(text)
    exact, near, quoted, address = [], 0, 0, 0
    for k, (at, w) in enumerate(words):
        hit = next((t for t in terms if t == w), None) or next((t for t in sorted(terms, key=len, reverse=True) if t.endswith("*") and w.startswith(t[:-1])), None)
        close = False
        for t in terms if not hit else ():
            body = t.rstrip("*")
            if len(body) >= (6 if t.endswith("*") else 5):
                close |= min(edits(body, w[:n]) for n in (range(min(len(w), len(body) + 2) + 1) if t.endswith("*") else [len(w)])) <= 1
        if not hit and not close:
            continue
        if any(a < at < b for a, b in spans) or any(w in tx.REPORT for _, w in words[max(0, k - 4) : k]):
            quoted += 1
            continue
        if hit:
            exact.append(hit)
        else:
            near += 1
        address += any(w in tx.ADDRESS for _, w in words[max(0, k - 8) : k + 9])
    per = 100 / (len(words) + 20)
    weight = sum(terms[t] for t in exact)
    return [math.log1p(len(exact)), len(exact) * per, math.log1p(weight), weight * per, math.log1p(near), near * per, quoted * per, address * per, math.log1p(len(set(exact))), math.log1p(len(words))]


def test_features_match_a_plain_version():
    rng = random.Random(11)
    terms = {"grubnork": 2.0, "zorbel*": 3.0, "idiot": 1.5, "馬鹿*": 2.5, "ขยะ*": 1.0, "élan": 0.5}
    lexicon = tx.Lexicon(terms)
    parts = ["Grubnork", "grubnrok", "grubnorkk", "ZORBELING", "zorbe", "idiot", "IDIOT", "idoit", "idiots", "élan", "você", "क्षि", "彼は馬鹿だよね", "こいつ馬鹿", "นี่คือขยะจริง", "said", "you", "tu", "hello", "world", "x" * 300, "grubnork" + "y" * 100, "İstanbul"]
    marks = list('"“”„«»‹›') + ["—", "…", ",", ".", "\n", "\t", " ", " ", " ", " ", "’", "\x01", "\x1f", "\r\n", "¿", "\u00a0"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) + "".join(rng.choice(marks) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(0, 14)))
        assert tx.features(text, lexicon) == pytest.approx(plain_features(text, terms)), text


def test_quotations_of_typographic_marks_and_of_any_length():
    lexicon = tx.Lexicon({"idiot": 5.0})
    at = tx.FEATURES.index
    long = "word " * 500
    for text in ("il a crié « tu es idiot » hier", "er rief „idiot“ laut", "they yelled “idiot” then", f'they yelled "{long} idiot {long}" then', "sie rief »idiot« laut"):
        assert tx.features(text, lexicon)[at("quoted density")] > 0 == tx.features(text, lexicon)[at("exact")], text
    for text in ("idiot—really", "an unanswered \" mark\nidiot \" here", "¡idiot!", "5\" pipe, idiot"):
        assert tx.features(text, lexicon)[at("exact")] > 0 == tx.features(text, lexicon)[at("quoted density")], text


def test_sure_terms_are_all_chosen_and_none_begins_another():
    rows = [(f"term{k:04d}", 40 + k % 7, 0) for k in range(900)] + [("term*", 3, 1), ("term0001x", 50, 0)]
    got = tx.choose_terms(rows, 100_000, 900_000)
    assert len(got) == 900 and "term0001" not in got and "term0001x" in got and "term*" not in got


def test_words_of_copies_are_no_terms():
    rows = [("awful", 200, 1), ("nasty", 150, 1), ("vile", 100, 1), ("house", 30, 0), ("garden", 29, 0), ("rare", 8, 0)]
    copies = [["awful", "garden", "house", "nasty", "vile"]] * 30
    documents = copies + [["awful", "nasty", "vile"]] * 30 + [["awful", "rare"]] * 7
    assert list(tx.choose_terms(rows, 10_000, 90_000, documents)) == ["awful", "nasty", "vile", "rare"]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "moron " * 30_000, None), (1, "x", "c")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.fit(docs, none)
    assert sorted(((r["id"], r["score"] < 0.5) for r in tx.toxicity(docs, model).collect()), key=str) == [(1, True), (1, True), (2, True), (None, True)]
    one_kind = tx.fit(docs, spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int"))
    assert one_kind.terms == {} and tx.toxicity(spark.createDataFrame([], DOCS), one_kind).collect() == []
