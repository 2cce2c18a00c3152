import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import token_files
from quarry.llm.simple8b import pack, read_block, unpack, write_block
from quarry.llm.token_files import Encoder, query, read, write

PATH = P.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1), st.just(0)), max_size=600))
def test_round_trip(values):
    v = np.array(values, np.uint64)
    words, escapes = pack(v)
    assert (unpack(words, escapes, len(v)) == v).all()
    assert len(words) <= len(v)


def test_density():
    assert len(pack(np.zeros(480, np.uint64))[0]) == 2
    assert len(pack(np.ones(120, np.uint64))[0]) == 2
    assert len(pack(np.full(300, 50_000, np.uint64))[0]) == 100
    assert len(pack(np.array([2**60, 2**60 - 1], np.uint64))[1]) == 1


def test_block():
    keys, ends, ids = read_block(write_block(np.array([5, -1]), np.array([2, 2]), np.array([7, 2**63], np.uint64)))
    assert keys.tolist() == [5, -1] and ends.tolist() == [2, 2] and ids.tolist() == [7, 2**63]
    with pytest.raises(ValueError):
        read_block(write_block(np.array([1]), np.array([0]), np.array([], np.uint64))[:-1])


def test_encoder_is_the_library():
    r = random.Random(3)
    texts = ["", " ", "a  b", "<|endoftext|> a<|endoftext|>", " x", "x "] + ["".join(r.choice("abé漢 \n\t.1'<|endoftext|>") for _ in range(r.randint(0, 300))) for _ in range(500)]
    library = Tokenizer.from_file(PATH)
    ids, size = Encoder(PATH)(pa.array(texts))
    for t, own in zip(texts, np.split(ids, np.cumsum(size)[:-1]), strict=True):
        assert own.tolist() == library.encode(t, add_special_tokens=False).ids


def test_files(spark, tmp_path):
    rows = [(3, "c c", 1), (None, "n", 1), (1, None, 1), (2, "", 1), (1, "same", 1), (1, "same", 1), (4, "long " * 40_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    out = f"file://{tmp_path}/f"
    write(df, out, path=PATH, block_ids=16)
    got = sorted(read(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 1, 2, 3, 4]
    library, at = Tokenizer.from_file(PATH), 0
    texts = {3: "c c", None: "n", 2: "", 4: "long " * 40_000}
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
        if r.doc_id in texts:
            assert np.frombuffer(r.ids, "<u4").tolist() == [*library.encode(texts[r.doc_id]).ids, 2]
    write(df.limit(0), f"{out}0", path=PATH)
    assert read(spark, f"{out}0").count() == 0


def test_shards_joined_or_broadcast(spark, tmp_path, monkeypatch):
    df = spark.range(300).selectExpr("id doc_id", "repeat('some words ', cast(id % 40 as int)) text")
    out = f"file://{tmp_path}/g"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write(df, out, path=PATH)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(out).select("shard").distinct().count() > 1
    want = sorted(map(tuple, read(spark, out).collect()))
    monkeypatch.setattr(token_files, "BROADCAST_SHARDS", 0)
    assert sorted(map(tuple, read(spark, out).collect())) == want and len(want) == 300


def test_query(spark, sf_dir):
    library, at = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in query(spark, sf_dir).collect()}
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(docs)
    for d, text in docs:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
