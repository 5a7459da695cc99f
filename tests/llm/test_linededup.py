from __future__ import annotations

import random

from bitquarry.llm import linededup as ld

SCHEMA = "doc_id long, text string"


def dedup(spark, rows, **options):
    return {r["doc_id"]: r["text"] for r in ld.dedup_lines(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def line(k):
    return f"line {k} has quite enough words to lead to something"


def test_patience_matches_is_a_common_subsequence_with_unique_lines_first():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        got = ld.patience_matches(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    assert ld.patience_matches([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert ld.patience_matches([1, 1, 1], [1, 1, 1]) == [(0, 0), (1, 1), (2, 2)]


def longest(pairs):
    best = [1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        best[k] = max([best[k]] + [best[m] + 1 for m in range(k) if pairs[m][1] < j])
    return max(best, default=0)


def test_longest_order_matches_quadratic():
    rng = random.Random(4)
    for _ in range(200):
        js = rng.sample(range(40), rng.randrange(0, 20))
        pairs = list(enumerate(js))
        got = ld._longest_order(pairs)
        assert len(got) == longest(pairs) and got == sorted(got) and [j for _, j in got] == sorted(j for _, j in got)


def brute(rows):
    """The lines that go: of all pairs of documents, what the later shares with the earlier. Nothing of the module is called."""
    from .brute import words

    texts = {d: [tuple(words(x)) for x in (t or "").split("\n")] for d, t in rows}
    return {d: {k for e in texts if e < d for k in shared_runs(texts[d], texts[e], [len(x) for x in texts[d]])} for d in texts}


def shared_runs(a, b, n_words):
    """The lines of a in runs of enough words that b has too, from all pairs of places; nothing of the module is called."""
    at = [i for i, x in enumerate(a) if x]
    a, b = [a[i] for i in at], [x for x in b if x]
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if sum(n_words[at[m]] for m in range(i, i + k)) >= ld.BLOCK_WORDS:
                out |= set(at[i : i + k])
    return sorted(out)


def test_no_common_block_is_left():
    rng = random.Random(6)
    for _ in range(600):
        size = [0] + [rng.randrange(1, 11) for _ in range(12)]
        kinds = rng.choice([4, 7, 13])
        a, b = ([rng.randrange(kinds) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        n_words = [size[x] for x in a]
        assert ld.common_blocks(a, b, n_words) == shared_runs(a, b, n_words)
    assert ld.common_blocks([1, 2, 3, 4], [3, 4, 1, 2], [9] * 4) == [0, 1, 2, 3]  # in another order
    assert ld.common_blocks([5, 1, 6, 1], [1, 7, 1], [9] * 4) == [1, 3]  # twice in both


def test_matches_brute_force(spark):
    rng = random.Random(8)
    pool = [line(k) for k in range(60)] + ["short one", "", "  ", "tiny"]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for d in range(80)]
    gone = {r["id"]: set(r["gone"]) for r in ld.repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert gone == {d: g for d, g in brute(rows).items() if g}


def test_blocks_of_short_lines_lead_to_alignments(spark):
    verse = "\n".join(f"verse {k} of a song" for k in range(20))
    rows = [(1, "one\n" + verse), (2, "two\n\n" + verse.replace("\n", "\n\n")), (3, "verse 3 of a song")]
    got = dedup(spark, rows)
    assert (got[1], got[2].split(), got[3]) == (rows[0][1], ["two"], rows[2][1])
    rng = random.Random(9)
    pool = [" ".join(f"w{k}" for _ in range(rng.randrange(1, 10))) for k in range(25)] + ["", " "]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 16)))) for d in range(60)]
    gone = {r["id"]: r["gone"] for r in ld.repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {d: set(g) for d, g in gone.items()} == {d: g for d, g in brute(rows).items() if g}


def test_blocks_whose_lines_have_different_first_documents_go(spark):
    one, two = "alpha beta gamma delta epsilon zeta eta", "one two three four five six seven"
    rows = [(1, one), (2, two), (3, f"{one}\n{two}"), (4, f"own line\n{one}\n{two}")]
    assert dedup(spark, rows) == {1: one, 2: two, 3: rows[2][1], 4: "own line"}
    short = "\n".join(f"four words at {k}" for k in range(40))
    assert dedup(spark, [(1, short), (2, short)]) == {1: short}
    many = [(d, f"head {d}\n{one}\n{two}") for d in range(30)]  # more documents than a rare line has
    assert dedup(spark, many) == {d: many[0][1] if d == 0 else f"head {d}" for d in range(30)}


def test_later_copy_goes_and_the_first_stays(spark):
    block = "\n".join(line(k) for k in range(5))
    rows = [(5, "own first line of this one document here\n" + block), (3, block + "\nend of the first document, all of its own"), (9, block), (11, "nothing that anyone else has said before now")]
    got = dedup(spark, rows)
    assert got == {3: rows[1][1], 5: "own first line of this one document here", 11: rows[3][1]}
    assert dedup(spark, rows, drop_empty=False)[9] == ""


def test_edge_cases(spark):
    assert dedup(spark, []) == {}
    long_text = "\n".join(line(k) for k in range(20_000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long_text), (6, long_text + "\nand one line more that is new"), (None, line(1)), (4, long_text)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA + ", gone int, id_ string")
    got = [(r["doc_id"], r["text"]) for r in ld.dedup_lines(docs).collect()]
    want = [(1, None), (2, ""), (3, "\n\n"), (4, long_text), (4, long_text), (6, "and one line more that is new"), (None, line(1))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ld.dedup_lines(docs).columns == docs.columns
