"""JSON-lines ledger of evaluation results: batches that count once, and a read that survives broken lines."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SCHEMA = (
    "query_id string, run_no bigint, difficulty string, em int, ex int, latency_sec double, "
    "input_tokens bigint, output_tokens bigint, cost_usd double, status string, outcome string, error string"
)
MANIFEST = "batch string, attempt string"


def write_attempt(records: DataFrame, path: str, batch: str) -> str:
    """Writes a batch's records as JSON lines, in a folder that no other attempt uses; its name."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"a batch is named by letters, digits, dots, dashes and underscores, not {batch!r}")
    attempt = uuid.uuid4().hex
    records.write.option("ignoreNullFields", False).json(f"{path}/records/batch={batch}/attempt={attempt}")
    return attempt


def append(records: DataFrame, path: str, batch: str) -> None:
    """Adds a batch. Its entry in the manifest is written last.

    An attempt that was cut off has no entry and counts for nothing; of a batch that was appended
    again, one attempt counts. So an append that failed, or may have, is simply repeated.
    """
    attempt = write_attempt(records, path, batch)
    entry = records.sparkSession.createDataFrame([(batch, attempt)], MANIFEST)
    entry.coalesce(1).write.mode("append").json(f"{path}/manifest")


def read_batches(spark: SparkSession, path: str, schema: str = LEDGER_SCHEMA) -> DataFrame:
    """Records of every batch in the manifest, once each."""
    counted = spark.read.schema(MANIFEST).json(f"{path}/manifest").groupBy("batch").agg(F.min("attempt").alias("attempt"))
    lines = spark.read.option("recursiveFileLookup", True).text(f"{path}/records")
    place = F.col("_metadata.file_path")
    named = lines.select(
        "value", *[F.regexp_extract(place, rf"/{name}=([^/]+)/", 1).alias(name) for name in ("batch", "attempt")]
    )
    return parsed(named.join(counted, ["batch", "attempt"], "left_semi"), schema)


def read(spark: SparkSession, path: str, schema: str = LEDGER_SCHEMA) -> DataFrame:
    """Records of a folder of JSON lines that is no ledger of batches."""
    return parsed(spark.read.text(path), schema)


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Records of all lines that are whole JSON and name a query.

    A line cut off by a crash, a blank line and a record without ``query_id`` are dropped.
    A field of an unexpected type reads as NULL and keeps its record.
    """
    record = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return lines.where(F.try_parse_json("value").isNotNull()).select(record.alias("r")).select("r.*").where(
        F.col("query_id").isNotNull() & (F.col("query_id") != "")
    )
