import random

import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarry.llm.common import spaced
from quarry.llm.token_counts import Counter, query, token_counts

NAME = "byte_bpe_50k.json"
EDGE = ["", " ", "  ", "a", "a  b", " a", "a ", "a \n b\n\n\n c", "x  y  z", "\x1c a\x1d b \x85c", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa aaa aaaaa", "don't we'll 'sup 's", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "é è ñ ß 漢字 🙂🙂 é", "1234567 12 3", "ab" * 3000, "-" * 5000, "\n" * 300, "!?!? .,., ((("]


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("aabcdeéß 漢🙂'st1 2.,\n\t \x1c-A") for _ in range(r.randint(0, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path(NAME))


def test_against_the_library(library):
    texts = EDGE + random_texts(1000)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = Counter(P.path(NAME))(pa.array(texts))["n_tokens"].tolist()
    assert [(t, a) for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_pieces_rebuild_the_text():
    for t in EDGE + random_texts(500, 2):
        assert " ".join(spaced(t)) == t


def test_rows(spark, library):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "a b", 9), (2, "a b", 9), (None, "x" * 200_000, 9)], "doc_id long, text string, n_tokens int")
    rows = sorted(map(tuple, token_counts(df, path=P.path(NAME)).collect()), key=repr)
    assert [r[2] for r in rows if r[0] == 2] == [0, 2, 2]
    assert [r[2] for r in rows if r[0] is None] == [len(library.encode("x" * 200_000).ids)]
    assert token_counts(df.limit(0), path=P.path(NAME)).count() == 0


def test_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 512)
