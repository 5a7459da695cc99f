from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest

from bitquarry.llm import records
from bitquarry.llm._tokens import Encoder, vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return t


def test_encoder_matches_the_library(plain):
    rng = random.Random(0)
    parts = ["a", "bé", " ", "  ", "\n", " \n", "\n\n", "\t", "'s", "'", "1", "23", ".", "!!", "'ll", ' "', " ", " ", "ß", "漢", "😀", "\x1c", "<|endoftext|>", "_", "-", "É", "́", "²", "word", " word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(3000)]
    texts += ["x" * 5000, "long " * 30_000, ""]
    encoder = Encoder(vocabulary())
    for i in range(0, len(texts), 300):
        part = texts[i : i + 300]
        for text, got, want in zip(part, encoder.encode(part), plain.encode_batch(part, add_special_tokens=False), strict=True):
            assert got == np.array(want.ids, "<u4").tobytes(), text


def test_clashing_hashes_are_noticed(plain):
    encoder = Encoder(vocabulary())
    encoder.encode(["alpha beta"])
    encoder.check[:] = 0  # as if the table held other words under these hashes
    assert encoder.encode(["alpha beta"]) == [np.array(plain.encode("alpha beta").ids, "<u4").tobytes()]


def test_file_round_trip_and_damage(tmp_path):
    path = f"file://{tmp_path}/part"
    rows = [(3, b"\1\0\2\0"), (None, b""), (-5, bytes(range(200)) * 50_000)]
    assert records.write_file(path, iter(rows), 2) == (3, 2 + 100 * 50_000)
    assert list(records.read_file(path)) == rows
    assert [records.read_record(path, k) for k in (2, 0, 1)] == [rows[2], rows[0], rows[1]]
    records.write_file(path, iter(rows[:1]), 2)
    assert list(records.read_file(path)) == rows[:1]
    raw = (tmp_path / "part.rec").read_bytes()
    length, check = struct.unpack("<QI", raw[:12])
    assert length == 13 and check == ((c := zlib.crc32(raw[:8])) >> 15 | (c << 17) & 0xFFFFFFFF) + 0xA282EAD8 & 0xFFFFFFFF
    for at in (0, 14, len(raw) - 1):
        (tmp_path / "part.rec").write_bytes(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
        with pytest.raises(ValueError):
            list(records.read_file(path))
    (tmp_path / "part.rec").write_bytes(raw[:-3])
    with pytest.raises((ValueError, struct.error)):
        list(records.read_file(path))


def test_query_against_the_tokenizer(spark, plain, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(-50, 500), " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([0, 1, 40])))) for _ in range(80)]
    rows += [(600, None), (601, ""), (602, "many " * 20_000), (602, "many " * 20_000), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    (tmp_path / "records").mkdir()
    records.write_file(f"file://{tmp_path}/records/part-000000-0-99", iter([(1, b"")]), 2)  # of an attempt that was lost
    manifest = records.write_token_records(docs, f"file://{tmp_path}/records")
    named = {r["path"].rsplit("/", 1)[1] for r in manifest.collect()}
    left = {f.name.rsplit(".", 1)[0] for f in (tmp_path / "records").iterdir() if not f.name.startswith(".")}
    assert left == named and "part-000000-0-99" not in left
    got = [tuple(r) for r in records.read_token_records(manifest).orderBy("start").collect()]
    want, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert got == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert records.read_token_records(records.write_token_records(empty, f"file://{tmp_path}/none")).collect() == []
