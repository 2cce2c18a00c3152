"""Which physical join a build side gets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Build rows from which the partitioned join is used.
RADIX_THRESHOLD = 1_000_000
STRATEGIES = ("adaptive", "single", "radix")
#: A partition of so many build rows at most is held as a hash table, which can't spill; beyond that both sides are sorted.
HASH_ROWS = 4_000_000


def choose(rows: int, threshold: int = RADIX_THRESHOLD) -> str:
    """`single` (one hash table, sent to every executor) below `threshold` build rows, else `radix`."""
    return "single" if rows < threshold else "radix"


def decide(build: DataFrame, strategy: str, threshold: int = RADIX_THRESHOLD, rows: int | None = None) -> tuple[str, int]:
    """(`single` or `radix`, the rows of `build`): what `strategy` comes to.

    Only a build of fewer than `threshold` rows is broadcast: two longs a row bound it to 16 bytes
    times `threshold`. `single` over a larger build is planned as `radix`, and the result is the same.
    Unless `rows` is given this counts the build's raw rows, which is one job (over Parquet, of footers only
    when nothing filters it).
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}, not {strategy!r}")
    rows = build.count() if rows is None else rows
    return ("radix" if strategy == "radix" else choose(rows, threshold)), rows


def hinted(build: DataFrame, plan: str, rows: int) -> DataFrame:
    """`build`, of `rows` rows at most, with the hint for `plan`."""
    if plan == "single":
        return F.broadcast(build)
    parts = int(build.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return build.hint("shuffle_hash" if rows <= HASH_ROWS * parts else "merge")
