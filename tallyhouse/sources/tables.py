"""Parquet table reads with declared schemas, and full-refresh table writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.session import scratch_dir

# Declared, not inferred: a read costs no extra job and no footer scan on the driver.
BASE_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_base(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(BASE_TABLES[name]).parquet(f"{folder}/{name}.parquet")


def full_refresh(rows: DataFrame, path: str) -> DataFrame:
    """Replace the table at ``path`` by ``rows`` and return it as stored."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once to the folder all executors share; their size is known from then on."""
    return full_refresh(rows, scratch_dir(rows.sparkSession, purpose))


# Rows that a task holds in memory comfortably, also if each grows to some hundred bytes.
ROWS_PER_TASK = 500_000


def dealt(rows: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Stored rows on as many tasks as their number asks for, whatever the session's partitions are.

    The keys should name a row, or nearly so: rows of one key share a task.
    """
    return rows.repartition(-(-rows.count() // rows_per_task) or 1, *keys)
