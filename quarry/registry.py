"""The registered join queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import first_match, inner_count, inner_rows, join_count, join_rows, partition_histogram, partition_offsets
from quarry.plans import bloom_session
from quarry.sources import table

Query = Callable[[SparkSession, str], DataFrame]
FILTERS = {"F": ("orders", "o_orderstatus", "F"), "BUILDING": ("customer", "c_mktsegment", "BUILDING")}


def _sides(spark: SparkSession, sf_dir: str, build: str, probe: str, only: str | None) -> tuple[DataFrame, DataFrame]:
    b = table(spark, sf_dir, build)
    if only:
        b = b.where(F.col(FILTERS[only][1]) == FILTERS[only][2])
    return b, table(spark, sf_dir, probe)


def _count(build: str, key: str, probe: str, probe_key: str, strategy: str, bloom: bool = False, only: str | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        b, p = _sides(bloom_session(spark) if bloom else spark, sf_dir, build, probe, only)
        return join_count(b, p, key=key, probe_key=probe_key, strategy=strategy, bloom=bloom)

    return query


def _rows(build: str, key: str, value: str, order_by: list[str], probe: str, probe_key: str, strategy: str, bloom: bool = False, only: str | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        b, p = _sides(bloom_session(spark) if bloom else spark, sf_dir, build, probe, only)
        return join_rows(b, p, key=key, value=value, probe_key=probe_key, order_by=order_by, strategy=strategy, bloom=bloom)

    return query


QUERIES: dict[str, Query] = {
    "join_count_single": _count("part", "p_partkey", "lineitem", "l_partkey", "single"),
    "join_count_radix": _count("lineitem", "l_orderkey", "orders", "o_orderkey", "radix"),
    "join_count_single_bloom": _count("labels", "doc_id", "documents", "doc_id", "single", True),
    "join_count_radix_bloom": _count("orders", "o_orderkey", "lineitem", "l_orderkey", "radix", True, "F"),
    "join_count_adaptive": _count("orders", "o_custkey", "events", "user_id", "adaptive"),
    "join_count_adaptive_bloom": _count("customer", "c_custkey", "orders", "o_custkey", "adaptive", True, "BUILDING"),
    "join_rows_single": _rows("orders", "o_custkey", "o_orderkey", ["o_orderkey"], "customer", "c_custkey", "single"),
    "join_rows_radix": _rows("lineitem", "l_orderkey", "l_partkey", ["l_linenumber"], "orders", "o_orderkey", "radix"),
    "join_rows_single_bloom": _rows("labels", "doc_id", "quality", ["quality"], "documents", "doc_id", "single", True),
    "join_rows_radix_bloom": _rows("orders", "o_orderkey", "o_custkey", ["o_custkey"], "lineitem", "l_orderkey", "radix", True, "F"),
    "join_rows_adaptive": _rows("orders", "o_custkey", "o_orderkey", ["o_orderkey"], "events", "user_id", "adaptive"),
    "join_rows_adaptive_bloom": _rows("customer", "c_custkey", "c_nationkey", ["c_nationkey"], "orders", "o_custkey", "adaptive", True, "BUILDING"),
    "inner_count_all_matches": lambda s, d: inner_count(table(s, d, "orders"), table(s, d, "events"), key="o_custkey", probe_key="user_id"),
    "inner_rows_all_matches": lambda s, d: inner_rows(table(s, d, "orders"), table(s, d, "customer"), key="o_custkey", value="o_orderkey", probe_key="c_custkey"),
    "self_join_count_first": _count("lineitem", "l_orderkey", "lineitem", "l_orderkey", "adaptive"),
    "self_join_count_all": lambda s, d: inner_count(table(s, d, "lineitem"), table(s, d, "lineitem"), key="l_orderkey", probe_key="l_orderkey"),
    "build_dedup_first": lambda s, d: first_match(table(s, d, "orders"), key="o_custkey", value="o_orderkey", order_by=["o_orderkey"]),
    "partition_histogram": lambda s, d: partition_histogram(table(s, d, "lineitem"), key="l_orderkey"),
    "partition_offsets": lambda s, d: partition_offsets(table(s, d, "lineitem"), key="l_orderkey"),
    "join_value_truncated": _rows("orders", "o_orderkey", "o_totalprice", ["o_orderkey"], "lineitem", "l_orderkey", "adaptive"),
}


def _semi(build: str, key: str, probe: str, probe_key: str, more: str = "") -> str:
    return f"SELECT COUNT(*) AS matches FROM {probe} p WHERE EXISTS (SELECT 1 FROM {build} b WHERE b.{key} = p.{probe_key}{more})"


def _first(build: str, key: str, value: str, order: str, probe: str, probe_key: str, where: str = "") -> str:
    ranked = f"SELECT {key} AS key, {value} AS value, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {build}{where}"
    return f"SELECT p.{probe_key} AS key, b.value FROM {probe} p JOIN ({ranked}) b ON b.key = p.{probe_key} AND b.rn = 1"


HISTOGRAM = "SELECT l_orderkey % 256 AS bucket, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey % 256"
ORACLE_SQL: dict[str, str] = {
    "join_count_single": _semi("part", "p_partkey", "lineitem", "l_partkey"),
    "join_count_radix": _semi("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "join_count_single_bloom": _semi("labels", "doc_id", "documents", "doc_id"),
    "join_count_radix_bloom": _semi("orders", "o_orderkey", "lineitem", "l_orderkey", " AND b.o_orderstatus = 'F'"),
    "join_count_adaptive": _semi("orders", "o_custkey", "events", "user_id"),
    "join_count_adaptive_bloom": _semi("customer", "c_custkey", "orders", "o_custkey", " AND b.c_mktsegment = 'BUILDING'"),
    "join_rows_single": _first("orders", "o_custkey", "o_orderkey", "o_orderkey", "customer", "c_custkey"),
    "join_rows_radix": _first("lineitem", "l_orderkey", "l_partkey", "l_linenumber, l_partkey", "orders", "o_orderkey"),
    "join_rows_single_bloom": _first("labels", "doc_id", "CAST(quality AS BIGINT)", "quality", "documents", "doc_id"),
    "join_rows_radix_bloom": _first("orders", "o_orderkey", "o_custkey", "o_custkey", "lineitem", "l_orderkey", " WHERE o_orderstatus = 'F'"),
    "join_rows_adaptive": _first("orders", "o_custkey", "o_orderkey", "o_orderkey", "events", "user_id"),
    "join_rows_adaptive_bloom": _first("customer", "c_custkey", "CAST(c_nationkey AS BIGINT)", "c_nationkey", "orders", "o_custkey", " WHERE c_mktsegment = 'BUILDING'"),
    "inner_count_all_matches": "SELECT COUNT(*) AS matches FROM events p JOIN orders b ON b.o_custkey = p.user_id",
    "inner_rows_all_matches": "SELECT p.c_custkey AS key, b.o_orderkey AS value FROM customer p JOIN orders b ON b.o_custkey = p.c_custkey",
    "self_join_count_first": _semi("lineitem", "l_orderkey", "lineitem", "l_orderkey"),
    "self_join_count_all": "SELECT COUNT(*) AS matches FROM lineitem p JOIN lineitem b ON b.l_orderkey = p.l_orderkey",
    "build_dedup_first": "SELECT key, value FROM (SELECT o_custkey AS key, o_orderkey AS value, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) b WHERE rn = 1",
    "partition_histogram": HISTOGRAM,
    "partition_offsets": f"SELECT bucket, CAST(SUM(n) OVER (ORDER BY bucket) - n AS BIGINT) AS start_pos, CAST(SUM(n) OVER (ORDER BY bucket) AS BIGINT) AS end_pos FROM ({HISTOGRAM}) h",
    "join_value_truncated": _first("orders", "o_orderkey", "CAST(FLOOR(o_totalprice) AS BIGINT)", "o_orderkey", "lineitem", "l_orderkey"),
}
