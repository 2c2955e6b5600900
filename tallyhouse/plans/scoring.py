"""Scores, roll-ups and work lists over evaluation results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.grading import EXCERPT_CHARS, any_grade, token_cost, worst_grade
from tallyhouse.functions.numeric import count_when, percent, rounded
from tallyhouse.functions.text import (
    case_id,
    ground_truth_shape,
    label_tags,
    question_slug,
    rubric_block,
    run_id,
    run_slug,
)
from tallyhouse.operators.ordered import numbered, percentiles
from tallyhouse.plans.querylog import query_log
from tallyhouse.plans.results import by_remainder, questions, results, runs
from tallyhouse.plans.star import Star
from tallyhouse.schema import DIFFICULTY_LETTERS, RESULT_DIMENSIONS


def rate(part: Column, whole: Column) -> Column:
    return rounded(part / whole, 4)


# -- row level --------------------------------------------------------------------------


def eval_token_cost(star: Star) -> DataFrame:
    cost = token_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return results(star).select("query_id", "model", F.round(cost, 8).alias("cost_usd"))


def eval_combine_dims(star: Star) -> DataFrame:
    """Time and date-operator grades folded into one."""
    combined = worst_grade(F.col("time_grade"), F.col("date_grade")).alias("time_frame")
    return results(star).groupBy("time_grade", "date_grade", combined).agg(F.count("*").alias("n"))


def eval_outcome(star: Star) -> DataFrame:
    return results(star).select("query_id", "run_no", "status", "outcome")


def eval_case_filter(star: Star, wanted: str = "12", difficulty: str = "medium") -> DataFrame:
    """Cases whose id is ``wanted`` or starts with it, of one difficulty."""
    name = F.col("query_id").cast("string")
    chosen = ((name == wanted) | F.startswith(name, F.lit(wanted))) & (F.col("difficulty") == difficulty)
    return results(star).where(chosen).select("query_id", "difficulty")


# -- roll-ups ---------------------------------------------------------------------------


def latency_percentiles(rows: DataFrame) -> DataFrame:
    """Median and 95th percentile per run of the latencies that were measured."""
    timed = rows.where(F.col("latency_sec") != 0)
    found = percentiles(timed, ["run_no"], "latency_sec", {"p50": 0.5, "p95": 0.95})
    return found.select(
        "run_no", rounded(F.col("p50"), 6).alias("p50_latency_sec"), rounded(F.col("p95"), 6).alias("p95_latency_sec")
    )


def eval_latency_percentiles(star: Star) -> DataFrame:
    return latency_percentiles(results(star))


def eval_run_summary(star: Star) -> DataFrame:
    """One row per run: totals, rates, latency, tokens, cost."""
    rows = results(star)
    n = F.count("*")

    def having(status: str) -> Column:
        return count_when(F.col("status") == status)

    totals = rows.groupBy("run_no").agg(
        n.alias("total"),
        having("pass").alias("passed"),
        having("fail").alias("failed"),
        count_when(F.col("outcome") == "review").alias("review"),
        having("error").alias("errors"),
        having("timeout").alias("timeouts"),
        rate(having("pass"), n).alias("pass_rate"),
        rate(F.sum("em"), n).alias("em_rate"),
        rate(F.sum("ex"), n).alias("ex_rate"),
        rate(count_when(~F.col("any_wrong")), n).alias("rubric_clean_rate"),
        rate(count_when((F.col("ex") == 1) & F.col("any_wrong")), n).alias("false_positive_rate"),
        rounded(F.coalesce(F.avg(F.when(F.col("latency_sec") != 0, F.col("latency_sec"))), F.lit(0.0)), 6).alias(
            "avg_latency_sec"
        ),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        rounded(F.sum("cost_usd"), 6).alias("total_cost_usd"),
    )
    return totals.join(latency_percentiles(rows), "run_no", "left").fillna(
        0.0, ["p50_latency_sec", "p95_latency_sec"]
    )


def eval_by_difficulty(star: Star) -> DataFrame:
    """Rates per run and difficulty; a level without cases shows zeros."""
    per_level = (
        results(star)
        .groupBy("run_no", "difficulty")
        .agg(
            F.count("*").alias("n"),
            rate(F.sum("em"), F.count("*")).alias("em"),
            rate(F.sum("ex"), F.count("*")).alias("ex"),
            rate(count_when(F.col("status") == "pass"), F.count("*")).alias("pass_rate"),
        )
    )
    levels = F.explode(F.array(*[F.lit(level) for level in DIFFICULTY_LETTERS]))
    every = per_level.select("run_no").distinct().select("run_no", levels.alias("difficulty"))
    return every.join(per_level, ["run_no", "difficulty"], "left").fillna(0)


def dimension_counts(rows: DataFrame) -> DataFrame:
    """Grades per run and dimension, counted in one pass and turned long afterwards."""
    counts = [F.count("*").alias("total")] + [
        count_when(F.col(d) == grade).alias(f"{d}_{grade}")
        for d in RESULT_DIMENSIONS
        for grade in ("correct", "flag", "wrong", "NA")
    ]
    wide = rows.groupBy("run_no").agg(*counts)
    lines = F.array(
        *[
            F.struct(
                F.lit(d).alias("dimension"),
                (F.col("total") - F.col(f"{d}_NA")).alias("graded"),
                F.col(f"{d}_correct").alias("correct"),
                F.col(f"{d}_flag").alias("flag"),
                F.col(f"{d}_wrong").alias("wrong"),
            )
            for d in RESULT_DIMENSIONS
        ]
    )
    return wide.select("run_no", "total", F.inline(lines))


def eval_by_dimension(star: Star) -> DataFrame:
    return dimension_counts(results(star)).drop("total")


def eval_dimension_health(star: Star) -> DataFrame:
    """Shares of each grade per dimension, worst dimension of a run first."""
    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, percent(part, F.nullif(whole, F.lit(0)), 1)).otherwise(0.0)

    graded = F.col("graded")
    shares = dimension_counts(results(star)).select(
        "run_no",
        "dimension",
        "graded",
        share(F.col("correct"), graded).alias("correct_pct"),
        share(F.col("wrong"), graded).alias("wrong_pct"),
        share(F.col("flag"), graded).alias("flag_pct"),
        share(F.col("total") - graded, F.col("total")).alias("na_pct"),
    )
    return shares.orderBy("run_no", F.desc(F.col("wrong_pct") + F.col("flag_pct")), "dimension")


def eval_cost_latency_by_difficulty(star: Star) -> DataFrame:
    return (
        results(star)
        .groupBy("run_no", "difficulty")
        .agg(
            rounded(F.avg("cost_usd"), 6).alias("avg_cost_usd"),
            rounded(F.avg("latency_sec"), 3).alias("avg_latency_sec"),
        )
    )


def eval_false_positives(star: Star) -> DataFrame:
    """Right rows by wrong SQL, per run."""
    hits = results(star).where((F.col("ex") == 1) & F.col("any_wrong"))
    return hits.groupBy("run_no").agg(F.count("*").alias("n_false_positives"))


# -- lists ------------------------------------------------------------------------------


def eval_failure_list(star: Star) -> DataFrame:
    """Failed cases with their wrong dimensions and the start of the predicted SQL."""
    wrong = F.array(*[F.when(F.col(d) == "wrong", F.lit(d)) for d in RESULT_DIMENSIONS])
    failed = results(star).where(F.col("status") != "pass")
    predicted = query_log(star).select("query_id", "sql_text")
    return failed.join(predicted, "query_id", "left").select(
        "query_id",
        "run_no",
        "difficulty",
        "trap",
        "em",
        "ex",
        F.array_join(F.array_compact(wrong), ",").alias("wrong_dims"),
        F.nullif(F.col("error"), F.lit("")).alias("error"),
        F.substring(F.coalesce("sql_text", F.lit("")), 1, EXCERPT_CHARS).alias("predicted_sql_excerpt"),
    )


def eval_pending_cases(star: Star) -> DataFrame:
    """Cases not in the ledger of finished ones."""
    cases = results(star).select("query_id", "difficulty")
    finished = results(star).where(F.col("run_no") < 3).select("query_id")
    return cases.join(finished, "query_id", "left_anti")


def eval_rerun_failures(star: Star, run_no: int = 1) -> DataFrame:
    """Cases that did not pass in one earlier run."""
    failed = results(star).where((F.col("run_no") == run_no) & (F.col("status") != "pass")).select("query_id")
    return results(star).select("query_id", "difficulty").join(failed, "query_id", "left_semi")


def eval_results_sorted(star: Star) -> DataFrame:
    return results(star).select("query_id", "run_no", "status").orderBy("query_id")


def eval_run_delta(star: Star) -> DataFrame:
    """Cases whose status changed between two runs; the second flips every tenth answer."""
    before = results(star).select("query_id", "ex", "any_wrong", F.col("status").alias("before"))
    flipped = F.when(F.col("query_id") % 10 == 3, 1 - F.col("ex")).otherwise(F.col("ex"))
    after = before.select(
        "query_id",
        F.when(~F.col("before").isin("pass", "fail"), F.col("before"))
        .when((flipped == 1) & ~F.col("any_wrong"), "pass")
        .otherwise("fail")
        .alias("after"),
    )
    change = F.when(F.col("after") == "pass", "fixed").when(F.col("before") == "pass", "broken").otherwise("other")
    return (
        before.select("query_id", "before")
        .join(after, "query_id")
        .where(F.col("before") != F.col("after"))
        .select("query_id", "before", "after", change.alias("change"))
    )


# -- runs and cases ---------------------------------------------------------------------


def run_ids(star: Star) -> DataFrame:
    stamp = F.date_format("started_at", "yyyyMMdd_HHmmss")
    return runs(star).withColumn("run_id", run_id(F.col("run_name"), stamp))


def run_id_slug(star: Star) -> DataFrame:
    return run_ids(star).select("user_id", "run_name", run_slug(F.col("run_name")).alias("slug"), "run_id")


def latest_runs(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Per wanted name the run with exactly this id, else the latest whose id starts with the name or its slug."""
    found = F.col("run_id")

    def latest(wanted: str) -> Column:
        name = F.lit(wanted)
        fits = (found == name) | F.startswith(found, F.concat(run_slug(name), F.lit("_"))) | F.startswith(found, name)
        # One pass over the runs for all names.
        choice = F.max_by(F.when(fits, found), F.when(fits, F.struct(found == name, F.col("started_at"), found)))
        return F.struct(name.alias("wanted"), choice.alias("run_id"))

    return rows.agg(F.array(*[latest(w) for w in wanted]).alias("all")).select(F.inline("all"))


def eval_latest_run(star: Star) -> DataFrame:
    return latest_runs(run_ids(star), ["Baseline", "prompt_v2_2024", "GPT-5.4 full 39", "no such run"])


def case_slug(star: Star) -> DataFrame:
    return questions(star).select("source_id", question_slug(F.col("question")).alias("slug"))


def case_id_assignment(star: Star) -> DataFrame:
    """Case ids: difficulty letter, running number per difficulty in source order, slug."""
    letters = F.create_map(*[F.lit(x) for pair in DIFFICULTY_LETTERS.items() for x in pair])
    asked = questions(star)
    counted = numbered(asked.select("source_id", "difficulty"), ["difficulty"], "source_id", "case_no")
    slugs = asked.select("source_id", question_slug(F.col("question")).alias("slug"))
    return counted.join(slugs, "source_id").select(
        "source_id",
        "difficulty",
        "case_no",
        case_id(letters[F.col("difficulty")], F.col("case_no"), F.col("slug")).alias("case_id"),
    )


def rubric_items_split(star: Star) -> DataFrame:
    """Rubric cells with either separator, stray blanks and empty parts."""
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    cell = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(name, F.lit(" ; "), brand, F.lit(", "), kind, F.lit(";;")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("  "), name, F.lit(" ,"), brand, F.lit(", ,")))
        .when(F.col("p_partkey") % 4 == 2, F.lit("   "))
        .otherwise(brand)
    )
    block = star.base("part").select("p_partkey", rubric_block(cell).alias("block"))
    return block.select(
        F.col("p_partkey").alias("case_no"),
        F.col("block.required").cast("int").alias("required"),
        F.col("block.spec").alias("spec"),
        F.array_join("block.items", "|").alias("items"),
        F.coalesce(F.size("block.items"), F.lit(0)).alias("n_items"),
    )


def ground_truth_report(star: Star) -> DataFrame:
    """Ground-truth cells in every form, one per order."""
    key, state = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    kind = F.col("o_orderkey") % 8
    cell = (
        F.when(kind == 0, F.concat(F.lit("[["), key, F.lit("]]")))
        .when(kind == 1, F.concat(F.lit('[["'), state, F.lit('", '), key, F.lit('], ["x", null]]')))
        .when(kind == 2, F.concat(F.lit('{"columns": ["k", "s"], "rows": [['), key, F.lit(', "'), state, F.lit('"]]}')))
        .when(kind == 3, F.concat(F.lit('{"rows": [['), key, F.lit("]]}")))
        .when(kind == 4, F.concat(F.lit('{"k": '), key, F.lit("}")))
        .when(kind == 5, F.concat(F.lit("[["), key))
        .when(kind == 6, F.lit("  "))
        .otherwise(F.lit("[]"))
    )
    shaped = star.base("orders").select("o_orderkey", ground_truth_shape(cell).alias("shape"))
    return shaped.select(
        F.col("o_orderkey").alias("case_no"),
        F.col("shape.form").alias("form"),
        F.coalesce(F.col("shape.n_rows"), F.lit(-1)).alias("n_rows"),
        F.coalesce(F.col("shape.n_cols"), F.lit(-1)).alias("n_cols"),
        F.col("shape.scalar").alias("scalar"),
    )


def case_tags(star: Star) -> DataFrame:
    """Documents per tag of their combined label."""
    label = F.concat("lang", F.lit(" + "), "source", F.lit("+long "))
    short = F.concat("lang", F.lit("+"), "source")
    labelled = star.base("documents").select(F.when(F.col("n_chars") > 1000, label).otherwise(short).alias("label"))
    return labelled.select(F.explode(label_tags(F.col("label"))).alias("tag")).groupBy("tag").agg(
        F.count("*").alias("n")
    )


RUBRIC_CELLS = ["table", "time_frame", "filters", "aggregation", "join", "date_operator"]


def drafted_cases(star: Star) -> DataFrame:
    """Case records with planted gaps: absent fields, bad levels, broken rubric blocks."""
    key = F.col("event_id")

    def unless(modulus: int, value: Column) -> Column:
        return F.when(key % modulus != 0, value)

    def block(dimension: str, salt: int) -> Column:
        draft = rubric_block(F.when((key + salt) % 3 != 0, F.concat(F.lit(f"{dimension} of "), "event_type")))
        kept = F.struct(
            F.when((key + salt) % 41 != 0, draft["required"]).alias("required"),
            F.when((key + salt) % 43 != 0, draft["spec"]).alias("spec"),
            F.when((key + salt) % 47 != 0, draft["items"]).alias("items"),
        )
        return F.when((key + salt) % 37 != 0, kept).alias(dimension)

    return star.base("events").select(
        unless(101, key).alias("id"),
        key.alias("case_no"),
        unless(23, by_remainder(key, 29, {0: "extreme", 1: "easy", 2: "hard"}, "medium")).alias("difficulty"),
        unless(31, F.array(F.lit("orders"))).alias("tables"),
        unless(19, F.col("event_type")).alias("question"),
        by_remainder(key, 17, {0: "   "}, "SELECT 1").alias("gold_sql"),
        unless(53, F.col("props")).alias("expected"),
        F.struct(*[block(d, i) for i, d in enumerate(RUBRIC_CELLS)]).alias("rubric"),
    )


# Fields every case must have, and the allowed difficulty levels.
REQUIRED_CASE_FIELDS = ["id", "difficulty", "tables", "question", "gold_sql", "expected", "rubric"]


def case_errors() -> Column:
    """Error codes of one case record, ``problem:field``, in checking order."""
    absent = [
        F.when(F.col(field).isNull(), f"absent:{field}") for field in REQUIRED_CASE_FIELDS
    ]
    levels = F.coalesce(F.col("difficulty").isin(*DIFFICULTY_LETTERS), F.lit(False))
    checks = [*absent, F.when(~levels, "unknown:difficulty")]
    checks.append(F.when(F.trim("gold_sql") == "", "empty:gold_sql"))
    for d in RUBRIC_CELLS:
        block = F.col("rubric")[d]
        needed = F.coalesce(block["required"], F.lit(False))
        checks += [
            F.when(block.isNull(), f"absent:rubric.{d}"),
            F.when(block.isNotNull() & block["required"].isNull(), f"absent:rubric.{d}.required"),
            F.when(needed & (F.coalesce(block["spec"], F.lit("")) == ""), f"empty:rubric.{d}.spec"),
            F.when(needed & block["items"].isNull(), f"absent:rubric.{d}.items"),
        ]
    return F.array_compact(F.array(*checks))


def case_quality_check(star: Star) -> DataFrame:
    """Every error of every case record, one row each."""
    checked = drafted_cases(star).select("case_no", F.posexplode_outer(case_errors()).alias("error_no", "error"))
    return checked.where(F.col("error").isNotNull())


def case_quality_totals(star: Star) -> DataFrame:
    """Cases that pass the check, of all."""
    checked = drafted_cases(star).select(F.size(case_errors()).alias("n_errors"))
    return checked.agg(count_when(F.col("n_errors") == 0).alias("n_valid"), F.count("*").alias("n_cases"))
