"""Ledger round trips and delivered result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numeric import count_when
from tallyhouse.functions.text import run_slug
from tallyhouse.plans.querylog import query_log
from tallyhouse.plans.results import results
from tallyhouse.plans.scoring import eval_run_summary
from tallyhouse.plans.star import Star
from tallyhouse.schema import RESULT_COLUMNS
from tallyhouse.session import scratch_dir
from tallyhouse.sources import ledger, sinks
from tallyhouse.sources.csv_files import scan_csv

LEDGER_FIELDS = [
    "query_id", "run_no", "difficulty", "em", "ex", "latency_sec",
    "input_tokens", "output_tokens", "cost_usd", "status", "outcome", "error",
]


def ledger_records(star: Star) -> DataFrame:
    return results(star).select(*LEDGER_FIELDS).withColumn("query_id", F.col("query_id").cast("string"))


def ledger_tolerant_read(star: Star) -> DataFrame:
    """A ledger with cut, blank and nameless lines in it, read back."""
    number = F.col("query_id").cast("bigint")
    named = F.when(number % 59 != 0, F.col("query_id")).otherwise("")
    whole = F.to_json(F.struct(named.alias("query_id"), *LEDGER_FIELDS[1:]))
    line = (
        F.when(number % 50 == 0, F.substring(whole, 1, 40)).when(number % 53 == 0, F.lit("")).otherwise(whole)
    )
    path = scratch_dir(star.spark, "ledger")
    ledger_records(star).select(line.alias("value")).write.text(path)
    return ledger.read(star.spark, path).select("query_id", "run_no", "ex", "latency_sec", "status")


def ledger_append(star: Star) -> DataFrame:
    """Runs appended in batches, one of them twice and one cut off before it was repeated, counted from the ledger."""
    path = scratch_dir(star.spark, "ledger-runs")
    records = ledger_records(star)
    early, late = records.where(F.col("run_no") < 2), records.where(F.col("run_no") >= 2)
    ledger.append(early, path, "early")
    ledger.append(early, path, "early")
    ledger.write_attempt(late, path, "late")
    ledger.append(late, path, "late")
    return (
        ledger.read_batches(star.spark, path)
        .groupBy("run_no")
        .agg(F.count("*").alias("n_records"), count_when(F.col("status") == "pass").alias("n_passed"))
    )


def with_predictions(star: Star) -> DataFrame:
    predicted = query_log(star).select("query_id", F.col("sql_text").alias("predicted_sql"))
    return results(star).join(predicted, "query_id", "left")


def results_csv_sink(star: Star) -> DataFrame:
    """The fixed-column file as it reads back: every cell is text, absent ones are NULL."""
    path = sinks.write_results_csv(with_predictions(star), scratch_dir(star.spark, "results-csv"))
    cells = scan_csv(star.spark, path).select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in RESULT_COLUMNS])
    # Decimals have more than one spelling.
    return cells.withColumns({c: F.col(c).cast("double") for c in ("latency_sec", "cost_usd")})


def results_case_split(star: Star) -> DataFrame:
    """Split files read back: cases and wrong grades per part and difficulty."""
    path = sinks.write_case_split(with_predictions(star), scratch_dir(star.spark, "case-split"))
    stored = star.spark.read.schema(
        "query_id bigint, difficulty string, ex int, predicted_sql string, part string, "
        "rubric struct<table string, time_frame string, filters string, aggregation string, join string>"
    ).json(path)
    return stored.groupBy("part", "difficulty").agg(
        F.count("*").alias("n_cases"),
        F.sum("ex").alias("n_right"),
        count_when(F.col("rubric")["table"] == "wrong").alias("n_table_wrong"),
        count_when(F.col("rubric")["join"] == "wrong").alias("n_join_wrong"),
        F.sum(F.length("predicted_sql")).alias("sql_chars"),
    )


def named_runs(star: Star) -> DataFrame:
    """Summaries of all runs with their names and ids."""
    name = F.concat(F.lit("Run No. "), F.col("run_no"))
    return eval_run_summary(star).select(
        "run_no", run_slug(name).alias("run_id"), name.alias("name"), F.lit("full").alias("mode"),
        "total", "passed", "review", "failed", "errors", "timeouts", "pass_rate", "ex_rate", "em_rate", "total_cost_usd",
    )


def results_run_document(star: Star) -> DataFrame:
    """Runs stored as JSON, opened again: headers beside what the case records hold."""
    path = sinks.write_runs(with_predictions(star), named_runs(star), scratch_dir(star.spark, "runs"))
    totals = (
        "struct<total: bigint, passed: bigint, review: bigint, failed: bigint, errors: bigint, timeouts: bigint, "
        "pass_rate: double, ex_rate: double, em_rate: double, total_cost_usd: double>"
    )
    headers = star.spark.read.schema(
        f"run_no bigint, run_id string, name string, mode string, totals {totals}, n_passes bigint, n_failures bigint"
    ).json(f"{path}/runs")
    cases = star.spark.read.schema("query_id bigint, status string, run_no bigint, part string").option(
        "recursiveFileLookup", True
    ).json(f"{path}/cases")
    passed = F.col("part") == "passes"
    found = cases.groupBy("run_no").agg(
        F.count_if(passed).alias("found_passes"), F.count_if(~passed).alias("found_failures"),
        F.sum(F.when(passed, F.col("query_id"))).alias("passes_sum"),
    )
    return headers.join(found, "run_no").select("*", "totals.*").drop("totals")
