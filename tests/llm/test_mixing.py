import re
from collections import defaultdict

import pytest
from oracle import assert_same, duck
from pyspark.sql import functions as F

from quarry.llm import mixing
from quarry.llm.mixing import SQL, mix, mixed_sql, query


def fill(sizes):
    """Targets by sharing out the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values())
    while left > 1e-6:
        free = [s for s in names if target[s] < 2 * sizes[s] - 1e-9]
        if not free:
            break
        total, spare = sum(weight[s] for s in free), 0.0
        for s in free:
            target[s] += left * weight[s] / total
            spare += max(0.0, target[s] - 2 * sizes[s])
            target[s] = min(target[s], 2.0 * sizes[s])
        left = spare
    return target


def holds(rows, sizes):
    taken, longest, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = r.row.source
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.row.text or "")) and r.source_size == sizes[s] and r.taken <= 2 * r["size"]
        taken[s] += r.taken
        longest[s] = max(longest[s], r["size"])
        target[s] = r.target
    for s, t in fill(sizes).items():
        assert target[s] == pytest.approx(t, rel=1e-9, abs=1e-6)
        assert abs(taken[s] - t) <= longest[s] / 2 + 1e-6


@pytest.mark.parametrize("case", ["even", "one", "tiny"])
def test_against_brute_force(spark, case):
    n = {"even": [400, 30, 300, 5, 60, None], "one": [50], "tiny": [1, 1, 1, 2]}[case]
    rows = [(j * 1000 + i, " ".join(["w"] * (1 + i * 7 % 23)) + "#" * (i % 4), f"s{j}", "x") for j, m in enumerate(n) for i in range(m or 20)]
    rows += [(None, None, None, "x"), (7, "", "s0", "x"), (None, "a b", None, "x"), (8, "dup dup", "s0", "x"), (8, "dup dup", "s0", "x"), (9, "alone", "empty?", "x"), (10, " \n", "blank", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mix(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    holds(got, sizes)
    assert sorted(map(repr, got)) == sorted(map(repr, mix(df.repartition(3)).collect()))
    assert mix(df.limit(0)).count() == 0


def test_heavier_documents_come_first(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w w w w "), F.when(F.col("id") % 2 == 0, "####").otherwise("abcd")).alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    rows = [r for r in mix(df).collect() if r.row.source == "a" and r.copies == r.target // r.source_size + 1]
    clean = sum(r.row.doc_id % 2 for r in rows)
    assert clean > 1.3 * (len(rows) - clean)


def test_sources_joined_or_broadcast(spark, monkeypatch):
    df = spark.range(600).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 9 as int)) text", "if(id % 7 = 0, null, concat('s', id % 50)) source")
    want = sorted(map(repr, mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mix(df).collect())) == want


def test_sql(spark, sf_dir):
    assert_same(query(spark, sf_dir), duck(sf_dir), SQL)
    assert "copies" in mixed_sql()
