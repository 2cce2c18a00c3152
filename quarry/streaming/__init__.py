"""Joins with a streaming probe. The build is static, so there is no state and no watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quarry.operators.joins import join_rows
from quarry.plans.strategy import RADIX_THRESHOLD


def stream_join_rows(build: DataFrame, probe_stream: DataFrame, *, key: str, value: str, probe_key: str, order_by: Sequence[str], strategy: str = "adaptive", threshold: int = RADIX_THRESHOLD, build_rows: int | None = None) -> DataFrame:
    """`join_rows` for a probe read with `readStream`; results follow each micro-batch.

    The strategy is fixed when this is called, by the build's rows as counted then, or by `build_rows`.
    """
    return join_rows(build, probe_stream, key=key, value=value, probe_key=probe_key, order_by=order_by, strategy=strategy, threshold=threshold, build_rows=build_rows)
