"""Parquet tables, and keys that arrive as numpy arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_uint64(spark: SparkSession, keys, values=None) -> DataFrame:
    """(key[, value]) from numpy arrays of 64-bit integers, unsigned ones by their bits.

    Shorter `values` are an error; extra ones are ignored.
    """
    import numpy as np
    import pandas as pd

    bits = lambda a: np.ascontiguousarray(np.asarray(a).reshape(-1)).astype(np.uint64 if np.asarray(a).dtype == np.uint64 else np.int64, copy=False).view(np.int64)
    k = bits(keys)
    if values is None:
        return spark.createDataFrame(pd.DataFrame({"key": k}), "key long")
    v = bits(values)
    if len(v) < len(k):
        raise ValueError(f"{len(k)} keys but {len(v)} values")
    return spark.createDataFrame(pd.DataFrame({"key": k, "value": v[: len(k)]}), "key long, value long")
