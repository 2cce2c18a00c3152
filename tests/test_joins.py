import os
import re

import numpy as np
import pytest
from oracle import assert_same, duck
from pyspark.sql import functions as F

from quarry.functions import canonical_key
from quarry.operators import inner_count, inner_rows, join_count, join_rows, partition_histogram, partition_offsets
from quarry.plans import bloom_session, choose
from quarry.plans.materialize import as_leaf, drop_leaf
from quarry.registry import ORACLE_SQL, QUERIES
from quarry.sources import discover, from_uint64, load_case, run_suite
from quarry.streaming import stream_join_rows

LONG = 2**63
FIXTURES = {
    "empty_build": ([], [1, 2], []),
    "empty_probe": ([(1, 10)], [], []),
    "dup_build": ([(1, 10), (1, 11), (2, 20)], [1, 2, 3], [(1, 10), (2, 20)]),
    "dup_probe": ([(1, 10)], [1, 1, 1], [(1, 10)] * 3),
    "extremes": ([(0, 1), (-1, 2), (-LONG, 3), (LONG - 1, 4)], [0, -1, -LONG, LONG - 1, 5], [(0, 1), (-1, 2), (-LONG, 3), (LONG - 1, 4)]),
    "null_key": ([(None, 1), (1, 2)], [None, 1], [(1, 2)]),
    "none_match": ([(2 * i, i) for i in range(50)], [2 * i + 1 for i in range(50)], []),
    "skew": ([(i, i) for i in range(20)], [7] * 180 + list(range(10, 30)), [(7, 7)] * 180 + [(i, i) for i in range(10, 20)]),
}


def sides(s, build, probe):
    return s.createDataFrame(build, "key long, value long"), s.createDataFrame([(k,) for k in probe], "key long")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_fixtures_hold_for_every_plan(spark, name):
    build, probe, want = FIXTURES[name]
    for bloom, s in ((False, spark), (True, bloom_session(spark))):
        for strategy in ("single", "radix", "adaptive"):
            b, p = sides(s, build, probe)
            opts = {"key": "key", "probe_key": "key", "strategy": strategy, "bloom": bloom, "threshold": 10}
            got = sorted(map(tuple, join_rows(b, p, value="value", order_by=["value"], **opts).collect()))
            assert got == sorted(want)
            assert join_count(b, p, **opts).first()[0] == len(want)


def test_all_matches(spark):
    b, p = sides(spark, [(1, 10), (1, 11), (2, 20), (None, 5)], [1, 1, 2, None])
    assert inner_count(b, p, key="key", probe_key="key").first()[0] == 5
    assert inner_rows(b, p, key="key", value="value", probe_key="key").count() == 5
    assert inner_count(*sides(spark, [], [1]), key="key", probe_key="key").first()[0] == 0


def test_threshold(spark):
    assert [choose(n, 10) for n in (9, 10, 11)] == ["single", "radix", "radix"]
    for n in (9, 10, 11):
        b, p = sides(spark, [(i, i) for i in range(n)], range(n))
        df = join_rows(b, p, key="key", value="value", probe_key="key", order_by=["value"], threshold=10)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (n < 10)
        assert ("ShuffledHashJoin" in plan) == (n >= 10)
        assert df.count() == n


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def filter_of(plan):
    """The attribute that the plan's Bloom filter is held against."""
    return re.search(r"might_contain\(scalar-subquery.*?, xxhash64\((\w+)#", plan)[1]


def test_bloom_prunes_the_probe(spark, sf_dir):
    for name, probe in (("join_count_radix_bloom", "l_orderkey"), ("join_rows_radix_bloom", "l_orderkey")):
        df = QUERIES[name](spark, sf_dir)
        df.collect()
        plan = optimized(df)
        assert plan.count("might_contain(") == 1 and filter_of(plan) == probe
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"


def test_bloom_follows_the_strategy(spark):
    s = bloom_session(spark)
    b, p = sides(s, [(i, i) for i in range(30)], range(100))
    opts = {"key": "key", "probe_key": "key", "bloom": True}
    for strategy, threshold, single in (("single", 100, True), ("single", 10, False), ("radix", 100, False), ("adaptive", 100, True), ("adaptive", 30, False)):
        for df in (join_count(b, p, strategy=strategy, threshold=threshold, **opts), join_rows(b, p, value="value", order_by=["value"], strategy=strategy, threshold=threshold, **opts)):
            plan = executed(df)
            assert ("BroadcastHashJoin" in plan, "ShuffledHashJoin" in plan) == (single, not single)
            assert "might_contain" not in optimized(df) if single else True
    for f in (lambda **o: join_count(b, p, **o), lambda **o: join_rows(b, p, value="value", order_by=["value"], **o)):
        for bloom in (True, False):
            with pytest.raises(ValueError):
                f(key="key", probe_key="key", strategy="nonsense", bloom=bloom)


def test_bloom_over_a_large_build(spark, tmp_path):
    """A build far above Spark's own limit of 10 MB and 4,000,000 filter items has a filter with room for it."""
    n = 4_200_000
    spark.range(n).selectExpr("id * 3 key", "id value").write.parquet(str(tmp_path / "build"))
    spark.range(20_000).selectExpr("id * 600 + id % 3 key").write.parquet(str(tmp_path / "probe"))
    s = bloom_session(spark)
    build, probe = s.read.parquet(str(tmp_path / "build")), s.read.parquet(str(tmp_path / "probe"))
    assert sum(f.stat().st_size for f in (tmp_path / "build").iterdir()) > 20 << 20
    for df in (join_count(build, probe, key="key", probe_key="key", bloom=True), join_rows(build, probe, key="key", value="value", probe_key="key", order_by=["value"], bloom=True)):
        plan = optimized(df)
        assert "ShuffledHashJoin" in executed(df) and filter_of(plan) == "key"
        bits = [int(x) for x in re.findall(r"bloom_filter_agg\(.*?, (\d+), (\d+), ", plan)[0]]
        assert bits == [n, 8 * n] if "bloom_filter_agg" in plan else True
    assert join_count(build, probe, key="key", probe_key="key", bloom=True).first()[0] == sum(1 for i in range(20_000) if i % 3 == 0 and i * 600 < 3 * n)


def test_builds_too_large_for_hash_tables_are_merged(spark):
    b, p = sides(spark, [(1, 2)], [1])
    df = join_rows(b, p, key="key", value="value", probe_key="key", order_by=["value"], build_rows=10**9)
    assert "SortMergeJoin" in executed(df) and df.count() == 1


def test_builds_are_counted_once(spark, monkeypatch):
    counted = []
    b, p = sides(spark, [(1, 2)], [1])
    kind = type(b)
    monkeypatch.setattr(kind, "count", lambda self, f=kind.count: counted.append(self) or f(self))
    join_rows(b, p, key="key", value="value", probe_key="key", order_by=["value"])
    assert counted == [b]
    join_rows(b, p, key="key", value="value", probe_key="key", order_by=["value"], build_rows=1)
    join_count(b, p, key="key", probe_key="key", build_rows=1, strategy="radix")
    assert counted == [b]


def test_buckets(spark):
    keys = [-1, -257, -256, 0, 255, 256, -LONG, LONG - 1, None]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    got = {r.bucket: r.n for r in partition_histogram(df, key="key").collect()}
    assert got == {b: n for b, n in ((255, 4), (0, 4))}
    strided = spark.range(0, 256 * 4096, 256).toDF("key")
    assert partition_histogram(strided, key="key").count() == 1
    spread = partition_histogram(strided, key="key", hashed=True).collect()
    assert len(spread) > 250 and max(r.n for r in spread) < 50 and all(0 <= r.bucket < 256 for r in spread)
    ends = partition_offsets(strided, key="key", hashed=True).agg(F.min("start_pos"), F.max("end_pos")).first()
    assert tuple(ends) == (0, 4096)


def test_dropped_leaves(spark):
    df = as_leaf(spark.range(5))
    files = df.inputFiles()
    assert files and "/quarry_" in files[0] and os.path.exists(files[0].removeprefix("file://"))
    drop_leaf(df, spark.range(3))
    assert not os.path.exists(os.path.dirname(files[0].removeprefix("file://")))
    drop_leaf(df)


def test_keys(spark):
    df = spark.sql("SELECT CAST(18446744073709551615 AS DECIMAL(20,0)) u, 2.7D d, -2.7D m, 'x' s")
    assert tuple(df.select(*[canonical_key(df, c) for c in "udm"]).first()) == (-1, 2, -2)
    with pytest.raises(TypeError):
        canonical_key(df, "s")
    got = from_uint64(spark, np.array([2**64 - 1, 0], dtype=np.uint64), np.array([1, 2, 3])).collect()
    assert [tuple(r) for r in got] == [(-1, 1), (0, 2)]
    with pytest.raises(ValueError):
        from_uint64(spark, np.array([1, 2]), np.array([1]))


def test_offsets_are_contiguous(spark, sf_dir):
    rows = partition_offsets(spark.range(1000), key="id", buckets=16).orderBy("bucket").collect()
    assert rows[0].start_pos == 0 and rows[-1].end_pos == 1000
    assert all(a.end_pos == b.start_pos for a, b in zip(rows, rows[1:], strict=False))


def test_csv_suite(spark, tmp_path):
    head = {"1e7_1e7": "id1,id2,id3,id5,v2", "1e7_1e1": "id1,v2", "1e7_1e4": "id2,id5,v2"}
    for name, cols in head.items():
        lines = [cols] + [",".join("a" if c == "id5" else str(i % 7) for c in cols.split(",")) for i in range(20)]
        (tmp_path / f"J1_{name}_0_0.csv").write_text("\n".join(lines))
    (tmp_path / "J1_2e7_2e7_0_0.csv").write_text("id1\n1")
    found = discover(str(tmp_path))
    assert list(found) == ["1e7"]
    assert load_case(spark, found["1e7"], "Q4") is None
    out = run_suite(spark, str(tmp_path)).collect()
    assert {r.case for r in out} == {"Q1", "Q2", "Q5"}
    for r in out:
        assert r.matches == 20 if r.variant != "all_matches" else r.matches > 20


def test_stream_probe(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("key")).write.parquet(str(tmp_path / "in"))
    b = spark.createDataFrame([(1, 5), (1, 4), (3, 3)], "key long, value long")
    stream = spark.readStream.schema("key long").parquet(str(tmp_path / "in"))
    q = stream_join_rows(b, stream, key="key", value="value", probe_key="key", order_by=["value"], strategy="radix").writeStream.format("memory").queryName("joined").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("joined").collect())) == [(1, 4), (3, 3)]
