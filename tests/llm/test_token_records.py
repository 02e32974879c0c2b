import struct
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridgeline.llm import token_records
from ridgeline.llm.crc32c import crc32c, masked
from ridgeline.session import run_path

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def slow_crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c():
    rng = np.random.default_rng(0)
    data = [b"", b"123456789", b"\0" * 300, *(rng.bytes(n) for n in (1, 7, 127, 128, 129, 1000))]
    assert crc32c(data).tolist() == [slow_crc(x) for x in data]
    assert crc32c([b"123456789"])[0] == 0xE3069283
    c = 0xE3069283
    assert masked(np.array([c]))[0] == (((c >> 15 | c << 17) & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def expected(rows):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_matches_the_library_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = expected([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = token_records.token_ids(spark, docs.repartition(3), PATH)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_odd_texts(spark):
    texts = [None, "", " \t\n", "It's I'LL can't", "<|endoftext|> x<|startoftext|>y", "éa ́b ÀÉß ﬁ İI", "ΑΣ ΣΑΣ.", "a b\x1cc\x0bd", "日本語 テスト 123 4½", "﻿x ‍👩‍👧", "a" * 20000, "\x00 \x85z", "ǅ ŉ"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("x"), "ids": F.lit(1), "part": F.lit(None)})
    got = token_records.token_ids(spark, docs, PATH)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expected(rows)


def test_other_tokenizers_go_through_the_library(tmp_path):
    import json

    texts = ["Hello  world, it's\n a Test", " x", "", "é\u0301 a"]
    state = json.load(open(PATH))
    state["normalizer"]["normalizers"].append({"type": "Prepend", "prepend": "_"})
    changed = tmp_path / "changed.json"
    changed.write_text(json.dumps(state))
    for path, by_word in ((PATH, True), (str(changed), False), (public_tokenizers.path("byte_bpe_50k.json"), False)):
        e, tok = token_records.Encoder(path), Tokenizer.from_file(path)
        assert e.by_word is by_word
        for t in texts:
            assert np.frombuffer(e.encode(t.encode()), e.width).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_records.token_ids(spark, empty, PATH).count() == 0
    rows = spark.createDataFrame([(None, "a"), (2, "b"), (2, "b")], "doc_id long, text string")
    got = token_records.token_ids(spark, rows, PATH).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in got] == [(None, 0), (2, 2), (2, 4)]


def test_damage_is_noticed(spark):
    from ridgeline.llm import files

    target = run_path(spark, "t")
    index = token_records.write_records(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), PATH, target)
    store, folder = files.open_store(target)
    row = index.first()
    with store.open_input_file(f"{folder}/{row.file}") as f:
        data = bytearray(f.read())
    data[13] ^= 1
    with store.open_output_stream(f"{folder}/{row.file}") as f:
        f.write(bytes(data))
    try:
        token_records.read_records(index, target).collect()
    except Exception as e:
        assert "damaged record" in str(e)
    else:
        raise AssertionError("no error")


def test_other_tasks_let_go_of_what_encoding_keeps():
    import public_tokenizers

    from ridgeline.llm import tasks, token_records

    path = public_tokenizers.path("word_bpe_49k.json")
    first = token_records.encoder(path)
    list(tasks.slim(lambda batches: batches, "encoder")(iter([])))
    assert token_records.encoder(path) is first
    list(tasks.slim(lambda batches: batches)(iter([])))
    assert not tasks._kept and token_records.encoder(path) is not first
