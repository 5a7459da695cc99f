from __future__ import annotations

import random

import pytest

import corpus_pipeline

pytest.importorskip("tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(7)
    prose = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n))
    clean = {d: "\n".join(prose(rng.randrange(9, 25)) for _ in range(rng.randrange(1, 6))) for d in range(300)}
    texts, labels, item = dict(clean), {d: 0 for d in clean}, prose(14)
    for d in range(300, 360):
        texts[d] = prose(20) + " " + " ".join(rng.choice(["grubnork", "flimwit", "snagdolt"]) for _ in range(3)) + " " + prose(10)
        labels[d] = 1
    texts[400] = clean[5] + "\n" + prose(12)  # an exact block of an earlier document, and a line of its own
    words = prose(120).split()
    texts[401] = " ".join(words)
    texts[402] = " ".join(words[:60] + ["changed"] + words[61:])
    texts[403] = prose(20) + " " + item.upper() + " " + prose(20)
    texts[404], texts[405] = "", None
    folder = tmp_path_factory.mktemp("tables")
    rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in texts.items()]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, t) for d, t in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, set(clean)


def test_each_stage_decides_and_keeps_clean_documents(spark, tables, tmp_path):
    folder, texts, clean = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert not set(range(300, 360)) & kept["toxicity"].keys() and clean | set(range(400, 406)) <= kept["toxicity"].keys()
    assert kept["line_dedup"][400]["text"] == texts[400].split("\n")[-1] and kept["line_dedup"][400]["n_chars"] == len(texts[400].split("\n")[-1])
    assert all(kept["line_dedup"][d]["text"] == texts[d] for d in clean)
    assert kept["line_dedup"].keys() - kept["minhash"].keys() == {402}
    assert kept["minhash"].keys() - kept["decontamination"].keys() == {403}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == kept["decontamination"].keys()
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(tuple(r)[:5] for r in whole.collect()) == sorted(tuple(r)[:5] for r in packed.collect())


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nulls_repeated_rows_and_other_columns_pass_through(spark, tmp_path):
    words = lambda c: " ".join(f"{c}{k}" for k in range(14))
    rows = [(None, words("n")), (7, words("s")), (7, words("s")), (8, None), (9, ""), (10, words("x") + "\n" + words("y"))]
    schema = DOCS + ", id_ string, gone_ int, gone string, digest string, runs int, line long"
    docs = spark.createDataFrame([(d, t, None, None, None, "a", 1, "b", "c", 2, None) for d, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(rows, key=str)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in packed), key=str) == sorted((d for d, _ in rows), key=str)
