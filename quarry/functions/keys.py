"""64-bit join keys. Spark has no unsigned long, so a key is the same 64 bits held in a signed one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_MIN = -(2**63)


def canonical_key(df: DataFrame, name: str) -> Column:
    """Column `name` of `df` as a long that carries the same 64 bits.

    Signed integers keep their sign. Decimals (how Parquet's UINT_64 arrives) above 2^63-1 are
    folded by subtracting 2^64. Fractions truncate toward zero; NaN and values out of range raise.
    Nulls stay null and match nothing.
    """
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.DecimalType):
        whole = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("decimal(38,0)")
        top = F.lit(str(2**63)).cast("decimal(38,0)")
        return F.when(whole >= top, whole - F.lit(str(2**64)).cast("decimal(38,0)")).otherwise(whole).cast("long")
    if isinstance(kind, T.NumericType):
        return c.cast("long")
    raise TypeError(f"{name} is {kind.simpleString()}; keys and values must be numeric")


#: Values are coerced by the same rule as keys.
canonical_value = canonical_key


def tautology(key: Column) -> Column:
    """True for every non-null long. As a predicate it marks a build side as filtered, which the
    optimizer asks for before it makes a run-time Bloom filter; null keys match nothing anyway."""
    return key >= F.lit(LONG_MIN)
