"""How rows spread over the buckets of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.keys import canonical_key

BUCKETS = 256


def bucket_of(key: Column, buckets: int = BUCKETS, hashed: bool = False) -> Column:
    """The bucket of a long, 0 to `buckets` - 1: its remainder, also of negative keys, or that of a hash of it, which spreads
    keys that lie at equal distances."""
    return F.pmod(F.xxhash64(key) if hashed else key, F.lit(buckets)).cast("long")


def partition_histogram(df: DataFrame, *, key: str, buckets: int = BUCKETS, hashed: bool = False) -> DataFrame:
    """(bucket, n): rows in each bucket of `bucket_of`. Null keys have no bucket."""
    k = canonical_key(df, key)
    return df.where(k.isNotNull()).select(bucket_of(k, buckets, hashed).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def partition_offsets(df: DataFrame, *, key: str, buckets: int = BUCKETS, hashed: bool = False) -> DataFrame:
    """(bucket, start_pos, end_pos): where each bucket's rows would lie, one after the other.

    The running sum is over one row a bucket, never over the table.
    """
    upto = F.sum("n").over(Window.orderBy("bucket"))
    return partition_histogram(df, key=key, buckets=buckets, hashed=hashed).select("bucket", (upto - F.col("n")).cast("long").alias("start_pos"), upto.cast("long").alias("end_pos"))
