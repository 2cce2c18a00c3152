import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarry.llm.bpe_codec import Codec, decode, decode_ids, encode_decode, query

PATH = P.path("word_bpe_49k.json")
EDGE = ["", " ", "\n\n", "a  b", "aaaaaaaaaaaaaaaaaaaaaaaa aaa aa", "ΣΑΣ Σ ΟΔΟΣ", "İstanbul ǅ ẞ", "é ́x Å", "don't WE'LL 's", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|> c", "123 4५६", "漢字🙂🙂", "a\x1cb\x85c　d e​f", "x" * 3000, "!?" * 500, "<|ENDOFTEXT|>"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_against_the_library(library):
    r = random.Random(5)
    texts = EDGE + ["".join(r.choice("aabcdeéÉß 漢🙂'sStT1 2.,\n\t \x1c-AΣ́") for _ in range(r.randint(0, 200))) for _ in range(1000)]
    got = {k: v.to_pylist() for k, v in Codec(PATH)(pa.array(texts)).items()}
    for t, ids, text in zip(texts, got["ids"], got["decoded"], strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert text == library.decode(want, skip_special_tokens=False), t
        assert decode(PATH, want) == text


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "a b", "x"), (2, "a b", "x"), (None, "x " * 100_000, "x")], "doc_id long, text string, ids string")
    rows = encode_decode(df, path=PATH).collect()
    assert sorted(len(r.ids) for r in rows) == [0, 0, 8, 8, 400_000]
    assert encode_decode(df.limit(0), path=PATH).count() == 0


def test_tables_of_ids(spark, library):
    """What was encoded is decoded from its ids alone; ids that the vocabulary doesn't have are passed over."""
    texts = [*EDGE, None, "Some words, AND more of them"]
    made = encode_decode(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), path=PATH)
    got = {r.doc_id: r for r in decode_ids(made.withColumnRenamed("decoded", "before"), path=PATH).collect()}
    for i, t in enumerate(texts):
        assert got[i].decoded == got[i].before == library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)
    odd = [(1, None), (2, b""), (3, np.array([320, 2**32 - 1, 49_407, 60_000, 320], "<u4").tobytes())]
    df = spark.createDataFrame([(*x, "old") for x in odd], "doc_id long, ids binary, decoded string")
    want = {1: "", 2: "", 3: library.decode([320, 49_407, 320], skip_special_tokens=False)}
    assert {r.doc_id: r.decoded for r in decode_ids(df, path=PATH).collect()} == want == {i: decode(PATH, np.frombuffer(b or b"", "<u4").tolist()) for i, b in odd}
    assert decode_ids(df.limit(0), path=PATH).count() == 0


def test_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
