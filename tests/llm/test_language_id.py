import math
import zlib

import numpy as np
import pyarrow as pa

from quarry.llm import language_id as L
from quarry.llm import registry
from quarry.llm.language_id import UNKNOWN, fit, identify, query, train


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    test = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in test)
    print("accuracy", right / len(test), "accepted", sum(r.accepted for r in rows) / len(rows), [(docs[r.doc_id].lang, r.lang_pred, round(r.score, 2), docs[r.doc_id].text[:60]) for r in test if r.lang_pred != docs[r.doc_id].lang])
    assert right >= 0.97 * len(test)
    assert sum(r.accepted for r in rows) >= 0.98 * len(rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, query(spark, sf_dir).collect()))


def test_edges(spark):
    df = spark.createDataFrame([(0, "aa bb aa", "x", 1), (2, "cc dd cc", "y", 1), (3, None, "x", 1), (4, "12 !?", None, 1), (None, "aa", "x", 1), (5, "漢字", None, 1), (6, "", None, 1), (7, "aa bb " * 50_000, "x", 1), (7, "aa bb", "x", 1), (7, "aa bb", "x", 1)], "doc_id long, text string, lang string, score int")
    rows = identify(df, train(df)).collect()
    assert len(rows) == 10
    for r in rows:
        assert (r.lang_pred == UNKNOWN) == (r.text in (None, "", "12 !?"))
        assert r.lang_pred != UNKNOWN or (r.score == 0 and not r.accepted)
    assert identify(df.limit(0), train(df.limit(0))).count() == 0
    assert {r.lang_pred for r in identify(df, fit([])).collect()} == {UNKNOWN}


def test_oracles_are_sql():
    assert all(isinstance(x, str) for x in registry.ORACLE_SQL.values()) and "op2_language_id" not in registry.ORACLE_SQL


def brute_subwords(text):
    """The bucket of each subword, one at a time."""
    raw = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in f" {text} ".lower().encode())
    out = []
    for i in range(len(raw)):
        for k in range(1, L.LONGEST + 1):
            own = raw[i : i + k]
            if len(own) == k and 0x20 not in own[1:-1] and not (own[0] == 0x20 and own[-1] == 0x20):
                h = 0
                for b in own:
                    h = (h * 0x01000193 + b + 1) % 2**32
                mixed = (h ^ h >> 15) * 0x85EBCA6B % 2**32
                out.append((mixed + k * 0x9E3779B9) % 2**32 >> 17)
    return out


TEXTS = ["a", "Hello, World! it's", "Größe und Maß über", "x1y2  z\tq\n", "é", "漢字 kana", "a" * 50, "one two three " * 40, " . b"]


def test_subwords_against_loops():
    for t in TEXTS:
        want = np.bincount(brute_subwords(t), minlength=L.BUCKETS)
        assert (L.counts(t) == want).all(), t


def test_forward_pass_against_loops(monkeypatch):
    """The average of each subword's row, under a softmax with its temperature, one number at a time."""
    r = np.random.default_rng(1)
    logits = np.concatenate([r.normal(0, 1, (L.BUCKETS, 3)), np.zeros((1, 3))]).astype(np.float32)
    model = L.Model(["x", "y", "z"], logits, np.array([0.1, -0.2, 0.05]), 0.3, 0.6)
    for part in (L.PART, 16):  # the second cuts the longer ones
        monkeypatch.setattr(L, "PART", part)
        got = model.predict(pa.array([*TEXTS, None, "", "12 ."]))
        for i, t in enumerate(TEXTS):
            own = brute_subwords(t)
            z = [(sum(float(logits[b, k]) for b in own) / len(own) + float(model.bias[k])) / model.temperature for k in range(3)]
            e = [math.exp(v - max(z)) for v in z]
            best = max(range(3), key=e.__getitem__)
            assert got["lang_pred"][i] == "xyz"[best] and abs(got["score"][i] - e[best] / sum(e)) < 1e-5
            assert got["accepted"][i] == (e[best] / sum(e) >= 0.6)
        assert got["lang_pred"][-3:] == ["und"] * 3 and not got["accepted"][-3:].any()


def test_long_text():
    long = "the words of a long text go on and on " * 1_300_000  # 50 MB
    r = np.random.default_rng(2)
    logits = np.concatenate([r.normal(0, 1, (L.BUCKETS, 2)), np.zeros((1, 2))]).astype(np.float32)
    model = L.Model(["x", "y"], logits, np.zeros(2), 1.0, 0.0)
    got = model.predict(pa.array([long[:39_000], "a b", long]))
    assert got["lang_pred"][0] == got["lang_pred"][2] and abs(got["score"][0] - got["score"][2]) < 1e-3
