"""One build row for each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.keys import canonical_key, canonical_value


def first_match(build: DataFrame, *, key: str, value: str, order_by: Sequence[str]) -> DataFrame:
    """(key, value) of the first row of each key in the order of `order_by`, then of the value.

    DataFrames have no row order, so the caller names one; the value as last sort key makes it total
    for what is returned. `min_by` combines map-side, so a hot key sends one row per task. Null keys
    match nothing and go first.
    """
    rows = build.select(canonical_key(build, key).alias("key"), canonical_value(build, value).alias("value"), *[F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order_by)])
    rank = F.struct(*[F.col(f"__o{i}") for i in range(len(order_by))], F.col("value"))
    return rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min_by("value", rank).alias("value"))
