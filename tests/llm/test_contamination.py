from __future__ import annotations

import random

from bitquarry.llm import contamination as ct

from . import brute

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def scan(spark, rows, items, **options):
    out = ct.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS), **options)
    return sorted(((r["id"], r["n_words"], r["n_hit"], list(r["items"])) for r in out.collect()), key=str)


def wanted(rows, items):
    found = brute.contamination([t for _, t in rows], [(str(i), t) for i, t in items])
    return sorted(((d, n, h, ids) for (d, _), (n, h, ids) in zip(rows, found, strict=True)), key=str)


def data(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha Beta gamma délta eps 12 zeta".split())
    items = [(k, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 30])))) for k in range(25)]
    rows = []
    for d in range(60):
        parts = [" ".join(f"{word()}{rng.randrange(50)}" for _ in range(rng.randrange(0, 30)))]
        if d % 2:
            w = rng.choice(items)[1].split()
            parts.append(" ".join(w[rng.randrange(0, 4) :]).upper().replace("É", "é").replace("DéLTA", "délta"))
        rows.append((d, " ".join(parts)))
    return rows, items


def test_matches_brute_force_in_one_block_and_in_many(spark):
    rows, items = data(1)
    want = wanted(rows, items)
    assert scan(spark, rows, items) == want
    assert scan(spark, rows, items, limit=700) == want


def test_edge_cases(spark):
    text = "one two three four five six seven eight nine ten"
    items = [(1, None), (2, ""), (3, text), (None, "lost words"), (4, "Tail!"), (3, text)]
    rows = [(1, None), (2, ""), (3, "x " * 30_000 + text + " y" * 30_000), (3, text), (None, text.upper()), (5, "tail tail"), (6, text[:-3])]
    assert scan(spark, rows, items) == wanted(rows, [i for i in items if i[0] is not None])
    assert scan(spark, [], items) == [] and scan(spark, rows, []) == wanted(rows, [])


def test_removal(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"Before. {text.title()} after", "a", 1), (2, "clean", "b", 2), (3, None, "c", 3)], DOCS + ", items string, key long")
    items = spark.createDataFrame([(7, text)], ITEMS)
    assert [r["doc_id"] for r in ct.decontaminate(docs, items).collect()] == [2, 3]
    spans = ct.decontaminate(docs, items, remove="spans")
    assert spans.columns == docs.columns and [r["text"] for r in spans.collect()] == ["Before.  after", "clean", None]


def test_spans_do_not_depend_on_the_blocks(spark):
    first, second = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 12), ("b", 8)))
    third = " ".join(f"c{k}" for k in range(10))  # stands right behind the first item's words
    rows = [(1, f"{first} {second}"), (2, f"x {first}, y"), (2, f"x {first}, y"), (None, "clean"), (4, None), (5, f"{first}; {third} z")]
    items = [(1, first), (9, third), (2, " ".join(first.split()[8:]) + " " + second)] + [(k, f"other{k} " * 12) for k in range(3, 9)]
    docs, bench = spark.createDataFrame([(d, t, "r", "d") for d, t in rows], DOCS + ", runs string, digest string"), spark.createDataFrame(items, ITEMS)
    for limit in (1 << 20, 400):
        out = ct.decontaminate(docs, bench, remove="spans", limit=limit)
        assert out.columns == docs.columns
        assert sorted((tuple(r)[:2] for r in out.collect()), key=str) == sorted([(1, ""), (2, "x , y"), (2, "x , y"), (None, "clean"), (4, None), (5, " z")], key=str)
        assert sorted((r["doc_id"] for r in ct.decontaminate(docs, bench, limit=limit).collect()), key=str) == [4, None]
        found = {r["id"]: (r["spans"], r["n_hit"]) for r in ct.contamination(docs, bench, limit=limit).collect()}
        assert found[1] == ([0, len(rows[0][1])], 20) and found[2] == ([2, 2 + len(first)], 12) and found[4] == ([], 0)


def test_spans_match_brute_force(spark):
    rows, items = data(3)
    one, many = (sorted(map(tuple, ct.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS), limit=limit).select("id", "spans").collect())) for limit in (1 << 20, 700))
    assert one == many and any(s for _, s in one)
