import hashlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline as C
from quarry.llm.jaccard_join import joined_sql
from quarry.llm.language_id import train
from quarry.llm.mixing import mixed_sql
from quarry.llm.quality_rules import judged_sql


def test_against_brute_force(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    con.execute(f"CREATE TABLE one AS SELECT d.* REPLACE (q.clean_text AS text, length(q.clean_text) AS n_chars) FROM documents d JOIN ({judged_sql(min_words=1)}) q USING (doc_id) WHERE q.kept")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = [docs]
    for _, f in C.STAGES:
        out = f"file://{tmp_path}/{len(stage)}"
        f(spark, stage[-1], sf_dir).write.parquet(out)
        stage.append(spark.read.parquet(out))
        assert len(stage) == len(C.STAGES) + 1 or stage[-1].dtypes == docs.dtypes
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert sorted((r.doc_id, r.text, r.n_chars) for r in stage[1].collect()) == con.execute("SELECT doc_id, text, n_chars FROM one ORDER BY 1").fetchall()
    model, texts = train(stage[1]), con.execute("SELECT doc_id, text FROM one").fetchall()
    ok = model.predict(pa.array([t for _, t in texts]))["accepted"]
    assert ids(stage[2]) == sorted(d for (d, _), a in zip(texts, ok, strict=True) if a)
    assert len(ids(stage[2])) >= 0.98 * len(texts)
    con.execute("CREATE TABLE two AS SELECT * FROM one WHERE list_contains(?, doc_id)", [ids(stage[2])])
    con.execute(f"CREATE TABLE three AS SELECT two.* FROM two JOIN ({joined_sql('two', C.NEAR)}) j USING (doc_id) WHERE doc_id = component_id")
    assert ids(stage[3]) == [r[0] for r in con.execute("SELECT doc_id FROM three ORDER BY 1").fetchall()]
    copies = dict(con.execute(f"SELECT doc_id, copies FROM ({mixed_sql('three')})").fetchall())
    assert Counter(ids(stage[4])) == Counter({d: n for d, n in copies.items() if n})
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for d, t in con.execute("SELECT doc_id, text FROM three").fetchall():
        own = library.encode(t, add_special_tokens=False).ids
        row = (d, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest())
        want += [row] * copies[d]
    assert sorted(map(tuple, stage[5].collect())) == sorted(want)


def test_stages_take_odd_rows(spark):
    text = " ".join(f"word{i} of" for i in range(80)) + "."
    rows = [(1, text, "en", "a", 5, 1.0), (1, text, "en", "a", 5, 1.0), (2, text, None, None, None, 1.0), (None, text, "en", "a", 1, 2.0), (None, None, None, None, None, None), (3, "", "en", "b", 0, 1.0), (4, text[::-1], "xx", "b", 7, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept double")
    kept = {"quality rules": 5, "language ID": 5, "n-gram Jaccard join": 2}
    now = docs
    for name, f in C.STAGES:
        now = spark.createDataFrame(f(spark, now, "").collect(), now.schema if name != C.STAGES[-1][0] else f(spark, now.limit(0), "").schema)
        assert now.count() == kept.get(name, now.count())
    assert {r.doc_id for r in now.collect()} <= {1, 4}


def test_near_duplicates_by_row(spark):
    """Ids that are missing or stand for several texts: a group loses all rows but one, and no other row goes."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(None, text("alone")), (None, text("a")), (1, text("a")), (None, text("b")), (None, text("b") + " b"), (None, text("b"))]
    rows += [(2, text("c")), (3, text("c") + " c"), (3, text("d")), (4, text("e")), (4, text("e")), (5, ""), (6, ""), (None, text("f")), (None, text("f"))]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int")
    got = C.near_duplicates(spark, docs, "")
    assert got.dtypes == docs.dtypes
    got = Counter((r.doc_id, r.text.split("0")[0]) for r in got.collect())
    assert got == Counter([(None, "alone"), (1, "a"), (None, "b"), (2, "c"), (3, "d"), (4, "e"), (5, ""), (6, ""), (None, "f")])


def test_run_on_nothing(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert C.run(spark, f"file://{tmp_path}").count() == 0
