"""The join benchmark over CSV files: finding its files, reading a case, timing the variants."""

from __future__ import annotations

import os
import re
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.keys import canonical_key
from quarry.operators.joins import inner_count, inner_rows, join_count, join_rows
from quarry.plans.bloom import bloom_session

#: Fixed values of the benchmark: case -> (build file, key column). The probe is always `x`, the value column always `v2`.
CASES = {"Q1": ("small", "id1"), "Q2": ("medium", "id2"), "Q4": ("medium", "id5"), "Q5": ("big", "id3")}
VALUE = "v2"


def discover(folder: str) -> dict[str, dict[str, str]]:
    """{size: {x, small, medium, big: path}} for each size of which all four files are there."""
    names = set(os.listdir(folder))
    found = {}
    for size in sorted({m[1] for n in names if (m := re.match(r"J1_(\de\d+)_", n))}):
        d = size[0]
        files = {"x": f"J1_{size}_{size}_0_0.csv", **{role: f"J1_{size}_{d}e{p}_0_0.csv" for role, p in (("small", 1), ("medium", 4), ("big", 7))}}
        if set(files.values()) <= names:
            found[size] = {k: f"{folder}/{v}" for k, v in files.items()}
    return found


def load_case(spark: SparkSession, files: dict[str, str], case: str) -> tuple[DataFrame, DataFrame] | None:
    """(build(key, value), probe(key)) of a case; None where a column is missing or isn't numeric."""
    role, k = CASES[case]
    build, probe = (spark.read.csv(files[r], header=True, inferSchema=True) for r in (role, "x"))
    if not ({k, VALUE} <= set(build.columns) and k in probe.columns):
        return None
    if not all(isinstance(df.schema[c].dataType, T.NumericType) for df, c in ((build, k), (build, VALUE), (probe, k))):
        return None
    return build.select(canonical_key(build, k).alias("key"), canonical_key(build, VALUE).alias("value")), probe.select(canonical_key(probe, k).alias("key"))


def materialized(df: DataFrame) -> int:
    """Makes every row of `df` with all its columns, keeps none, and returns how many there were."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


def run_suite(spark: SparkSession, folder: str) -> DataFrame:
    """(size, case, task, variant, matches, seconds) of every case and variant under `folder`. Runs of join_rows make all
    rows with both columns. Seconds include counting the build, from a cache."""
    names = {"key": "key", "probe_key": "key"}
    rows = []
    for size, files in discover(folder).items():
        for bloom, s in ((False, spark), (True, bloom_session(spark))):
            for case in CASES:
                if (loaded := load_case(s, files, case)) is None:
                    continue
                build, probe = (x.cache() for x in loaded)
                runs = {}
                for strategy in ("adaptive", "single", "radix"):
                    opts = names | {"strategy": strategy, "bloom": bloom}
                    runs["join_count", strategy + "_bloom" * bloom] = lambda o=opts: join_count(build, probe, **o)  # noqa: B023
                    runs["join_rows", strategy + "_bloom" * bloom] = lambda o=opts: join_rows(build, probe, value="value", order_by=["value"], **o)  # noqa: B023
                if not bloom:
                    runs["join_count", "all_matches"] = lambda: inner_count(build, probe, **names)  # noqa: B023
                    runs["join_rows", "all_matches"] = lambda: inner_rows(build, probe, value="value", **names)  # noqa: B023
                for (task, variant), f in runs.items():
                    began = time.perf_counter()
                    n = f().first()[0] if task == "join_count" else materialized(f())
                    rows.append((size, case, task, variant, n, time.perf_counter() - began))
                build.unpersist()
                probe.unpersist()
    return spark.createDataFrame(rows, "size string, case string, task string, variant string, matches long, seconds double")
