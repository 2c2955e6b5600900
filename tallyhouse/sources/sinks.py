"""Result sinks: the fixed-column file, the pass/fail split, and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.schema import RESULT_COLUMNS
from tallyhouse.sources.csv_files import as_it_is
from tallyhouse.sources.tables import full_refresh

SPLIT_DIMENSIONS = ["table", "time_frame", "filters", "aggregation", "join"]
CASE_FIELDS = [
    "query_id", "question", "difficulty", "status", "outcome", "em", "ex", "latency_sec", "cost_usd",
    "input_tokens", "output_tokens", "error", "gold_sql", "predicted_sql",
]


def write_results_csv(results: DataFrame, path: str) -> str:
    """All result columns in file order; an absent column or NULL leaves an empty cell."""
    cells = [F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in RESULT_COLUMNS]
    writer = results.select(*cells).write.mode("overwrite").option("header", True).option("escape", '"')
    as_it_is(writer.option("nullValue", "").option("emptyValue", "")).csv(path)
    return path


def case_document(results: DataFrame) -> Column:
    """One case as a nested record with its grades under ``rubric``."""
    grades = F.struct(*[F.coalesce(F.col(d), F.lit("NA")).alias(d) for d in SPLIT_DIMENSIONS])
    fields = [F.col(c) if c in results.columns else F.lit("").alias(c) for c in CASE_FIELDS]
    return F.struct(*fields, grades.alias("rubric"))


def write_case_split(results: DataFrame, path: str) -> str:
    """Case records as JSON lines, passing and failing ones in folders of their own."""
    split = results.select(
        F.when(F.col("status") == "pass", "passes").otherwise("failures").alias("part"),
        case_document(results).alias("case"),
    )
    split.select("part", "case.*").write.mode("overwrite").partitionBy("part").json(path)
    return path


# Characters of case records that make a file; the last of a run's may be smaller.
FILE_CHARS = 128 << 20


def write_runs(results: DataFrame, runs: DataFrame, path: str, file_chars: int = FILE_CHARS) -> str:
    """Each run as a header record under ``runs``, the case records of all under ``cases``.

    Headers hold ids, totals and the number of case records. Cases are laid in files by weight:
    runs, each with its passes and its failures, stand in a line, measured in characters, which
    is cut every ``file_chars``. So small runs share a file and a large one has several, and there
    are no more files than the cases fill. ``files`` tells which ones (``file`` from
    ``first_file`` to ``last_file``) hold a run's passes or failures. ``runs`` has run_no, run_id,
    name, mode and the totals.
    """
    ids = ["run_no", "run_id", "name", "mode"]
    totals = F.struct(*[c for c in runs.columns if c not in ids]).alias("totals")
    part = F.when(F.col("status") == "pass", "passes").otherwise("failures")
    cases = results.select("run_no", part.alias("part"), case_document(results).alias("case"))
    weighed = cases.groupBy("run_no", "part").agg(
        F.count("*").alias("n"), F.sum(F.length(F.to_json("case"))).cast("bigint").alias("chars")
    )
    # A row per run and part.
    line = Window.orderBy("run_no", "part").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("chars").over(line), F.lit(0))
    files = full_refresh(
        weighed.withColumn("begin", begin).select(
            "run_no", "part", "n", F.floor(F.col("begin") / file_chars).alias("first_file"),
            F.floor((F.col("begin") + F.greatest("chars", F.lit(1)) - 1) / file_chars).alias("last_file"),
        ),
        f"{path}/files",
    )
    counted = files.groupBy("run_no").agg(
        *[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(f"n_{p}") for p in ("passes", "failures")]
    )
    headers = runs.select(*ids, totals).join(counted, "run_no", "left").fillna(0, ["n_passes", "n_failures"])
    headers.write.mode("overwrite").json(f"{path}/runs")
    span = F.col("last_file") - F.col("first_file") + 1
    dealt = cases.join(files, ["run_no", "part"]).withColumn(
        "file", F.col("first_file") + F.pmod(F.xxhash64("case.query_id"), span)
    )
    dealt.select("file", "run_no", "part", "case.*").repartition("file").write.mode("overwrite").partitionBy("file").json(f"{path}/cases")
    return path
