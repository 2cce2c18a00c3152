"""Run-time Bloom filters over the probe side.

Spark makes these itself, under conditions; this module holds what the conditions ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.materialize import as_leaf

CONF = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "quarry.bloom": "true",
}
#: Bits of a filter for each build row, which let 3 in 100 others through, and of a filter as a whole: 64 MB, which go to every task.
BITS_A_ROW, MOST_BITS = 8, 1 << 29


def bloom_session(spark: SparkSession) -> SparkSession:
    """A session beside `spark` (same context and cluster) whose shuffled joins get Bloom filters.

    The caller's own session keeps its settings.
    """
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    for k, v in CONF.items():
        own.conf.set(k, v)
    return own


def fit_filter(spark: SparkSession, rows: int) -> None:
    """Makes room for a filter over `rows` build rows, if `spark` is a bloom session; what it has room for already stays.

    Spark's own limits, which count a filter out for builds above 10 MB, give way to one in rows: builds of
    more than MOST_BITS / BITS_A_ROW rows get a filter of MOST_BITS that lets more through.
    """
    if spark.conf.get("quarry.bloom", None) != "true":
        return
    named = "spark.sql.optimizer.runtime.bloomFilter."
    rows = max(rows, int(spark.conf.get(named + "expectedNumItems")))
    bits = min(MOST_BITS, max(rows * BITS_A_ROW, int(spark.conf.get(named + "maxNumBits"))))
    spark.conf.set(named + "creationSideThreshold", str(1 << 60))
    for k, v in (("expectedNumItems", rows), ("maxNumItems", max(rows, int(spark.conf.get(named + "maxNumItems")))), ("numBits", max(min(MOST_BITS, rows * BITS_A_ROW), int(spark.conf.get(named + "numBits")))), ("maxNumBits", bits)):
        spark.conf.set(named + k, str(v))


def creation_side(build: DataFrame) -> DataFrame:
    """`build` cut to a leaf of the plan. Over an aggregate the optimizer would copy the marking
    predicate to the probe and prune the build instead, which is the wrong way round."""
    return as_leaf(build)
