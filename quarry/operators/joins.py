"""Equi-joins on one 64-bit key.

`join_count` and `join_rows` match each probe row with one build row at most: the first of its key.
`inner_count` and `inner_rows` match it with all. Strategy and Bloom filter change the plan, never
the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.keys import canonical_key, canonical_value, tautology
from quarry.operators.dedupe import first_match
from quarry.plans.bloom import creation_side, fit_filter
from quarry.plans.strategy import RADIX_THRESHOLD, decide, hinted


def _probe(probe: DataFrame, probe_key: str) -> DataFrame:
    return probe.select(canonical_key(probe, probe_key).alias("key"))


def _marked(build: DataFrame, rows: int) -> DataFrame:
    """`build` as the side that a Bloom filter is made of, with room for its rows."""
    fit_filter(build.sparkSession, rows)
    return build.where(tautology(F.col("key")))


def join_count(build: DataFrame, probe: DataFrame, *, key: str, probe_key: str, strategy: str = "adaptive", bloom: bool = False, threshold: int = RADIX_THRESHOLD, build_rows: int | None = None) -> DataFrame:
    """(matches): how many probe rows have their key in the build, as one row.

    A semi join: values aren't read and build duplicates need no dedupe. `bloom` asks for a filter on
    the probe scan where the join is partitioned; it takes effect in a `bloom_session`. A broadcast table
    prunes what a filter would. The build's rows are counted when this is called, unless `build_rows` says how many.
    """
    plan, rows = decide(build, strategy, threshold, build_rows)
    keys = build.select(canonical_key(build, key).alias("key"))
    if bloom and plan == "radix":
        keys = _marked(keys, rows)
    return _probe(probe, probe_key).join(hinted(keys, plan, rows), "key", "left_semi").agg(F.count(F.lit(1)).alias("matches"))


def join_rows(build: DataFrame, probe: DataFrame, *, key: str, value: str, probe_key: str, order_by: Sequence[str], strategy: str = "adaptive", bloom: bool = False, threshold: int = RADIX_THRESHOLD, build_rows: int | None = None) -> DataFrame:
    """(key, value) for each probe row whose key is in the build, with the value of its first build row.

    `strategy`, `bloom` and `build_rows` are those of `join_count`; rows are those of the build as it is given.
    """
    plan, rows = decide(build, strategy, threshold, build_rows)
    first = first_match(build, key=key, value=value, order_by=order_by)
    if bloom and plan == "radix":
        first = _marked(creation_side(first), rows)
    return _probe(probe, probe_key).join(hinted(first, plan, rows), "key", "inner").select("key", "value")


def inner_rows(build: DataFrame, probe: DataFrame, *, key: str, value: str, probe_key: str) -> DataFrame:
    """(key, value) for each pair of a probe and a build row with equal keys; Catalyst picks the plan."""
    rows = build.select(canonical_key(build, key).alias("key"), canonical_value(build, value).alias("value"))
    return _probe(probe, probe_key).join(rows, "key", "inner").select("key", "value")


def inner_count(build: DataFrame, probe: DataFrame, *, key: str, probe_key: str) -> DataFrame:
    """(matches): how many pairs of a probe and a build row have equal keys.

    Both sides are counted by key before they meet, so a key with many rows on both sides makes one
    row, not their product.
    """
    side = lambda df, name, n: df.select(canonical_key(df, name).alias("key")).where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias(n))
    pairs = side(probe, probe_key, "p").join(side(build, key, "b"), "key", "inner")
    return pairs.agg(F.coalesce(F.sum(F.col("p") * F.col("b")), F.lit(0)).cast("long").alias("matches"))
