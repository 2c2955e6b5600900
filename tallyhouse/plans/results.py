"""Evaluation tables shaped from the base tables: results, runs, questions, cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.grading import any_grade, outcome, status, token_cost, worst_grade
from tallyhouse.plans.star import Star
from tallyhouse.schema import RESULT_DIMENSIONS


def by_remainder(key: Column, modulus: int, values: dict[int, str], default: str) -> Column:
    chosen = None
    for remainder, value in values.items():
        hit = key % modulus == remainder
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    return chosen.otherwise(default)


def results(star: Star) -> DataFrame:
    """One graded row per (run, query). The run without hard cases is number 4."""
    key = F.col("event_id")
    run = F.col("user_id") % 5
    difficulty = (
        F.when(key % 3 == 0, "easy").when(key % 3 == 1, "medium").when(run == 4, "easy").otherwise("hard")
    )
    raw = star.base("events").select(
        key.alias("query_id"),
        run.alias("run_no"),
        difficulty.alias("difficulty"),
        by_remainder(key, 4, {0: "gpt-4o", 1: "gpt-4o-mini", 2: "gpt-5.4"}, "other").alias("model"),
        (key % 97 == 0).cast("int").alias("em"),
        F.col("event_type").isin("click", "view", "purchase").cast("int").alias("ex"),
        F.when(key % 29 != 0, F.round("value", 3)).otherwise(0.0).alias("latency_sec"),
        (key % 1000 + 5000).alias("input_tokens"),
        (key % 200 + 20).alias("output_tokens"),
        by_remainder(key, 13, {0: "wrong", 1: "flag", 2: "NA"}, "correct").alias("table"),
        by_remainder(key, 7, {0: "wrong", 1: "flag", 2: "NA"}, "correct").alias("filters"),
        by_remainder(key, 17, {0: "wrong", 1: "flag", 2: "NA", 3: "NA"}, "correct").alias("aggregation"),
        by_remainder(key, 11, {0: "wrong", 1: "flag"}, "correct").alias("join"),
        by_remainder(key, 5, {0: "NA", 1: "NA", 2: "flag"}, "correct").alias("time_grade"),
        by_remainder(key, 6, {0: "NA", 1: "NA", 2: "NA", 3: "wrong"}, "correct").alias("date_grade"),
        (key % 31 == 0).alias("refused"),
        (key % 83 == 0).alias("timed_out"),
        # An exception nobody expected, unlike a refusal.
        (key % 61 == 0).alias("crashed"),
        by_remainder(key, 14, {3: "zip fan-out", 8: "untranslated category"}, "").alias("trap_name"),
    )
    graded = raw.withColumn("time_frame", worst_grade(F.col("time_grade"), F.col("date_grade")))
    grades = [F.col(d) for d in RESULT_DIMENSIONS]
    wrong, flagged = any_grade(grades, "wrong"), any_grade(grades, "flag")
    ex, refused, timed_out, crashed = F.col("ex"), F.col("refused"), F.col("timed_out"), F.col("crashed")
    cost = token_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return (
        graded.withColumn("any_wrong", wrong)
        .withColumn("any_flag", flagged)
        .withColumn("status", status(ex, wrong, refused, timed_out, crashed))
        .withColumn("outcome", outcome(ex, wrong, flagged, refused, timed_out, crashed))
        .withColumn("trap", F.nullif(F.col("trap_name"), F.lit("")))
        .withColumn(
            "error",
            F.when(timed_out, "statement timeout").when(crashed, "ValueError: no answer")
            .when(refused, "refused by rule R7").otherwise(""),
        )
        .drop("trap_name")
        .withColumn("cost_usd", F.round(cost, 8))
    )


def runs(star: Star) -> DataFrame:
    """Named runs with their start: one per user."""
    user = F.col("user_id")
    name = by_remainder(
        user, 5, {0: "Baseline 4o-mini!", 1: "Prompt v2", 2: "baseline", 3: "  GPT-5.4 (full 39)  "}, "***"
    )
    return star.base("events").groupBy("user_id").agg(F.max("ts").alias("started_at")).select(
        name.alias("run_name"), "user_id", "started_at"
    )


def questions(star: Star) -> DataFrame:
    """User turns of the conversations as questions; the source id keeps their order."""
    turn = F.col("turn")
    return (
        star.base("conversations")
        .where(F.col("role") == "user")
        .select(
            (F.col("conv_id") * 1000 + turn).alias("source_id"),
            by_remainder(F.col("conv_id"), 3, {0: "easy", 1: "medium"}, "hard").alias("difficulty"),
            F.col("text").alias("question"),
        )
    )
