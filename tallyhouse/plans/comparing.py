"""Comparison of result sets: one case per seller, answers derived from the line items.

The predicted side carries one kind of deviation per case, chosen by the seller number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.compare import cells_of, compare_results, exact_difference
from tallyhouse.plans.grain import line_value
from tallyhouse.plans.star import Star
from tallyhouse.sources.tables import ROWS_PER_TASK, dealt, stored

EMPTY_CASES_FROM = 1_000_000


def gold_answer(star: Star, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Units, value and brand per seller and product; unclassified products have NULL.

    Stored, as both sides are made from it. Its rows widen into cells and are counted before
    they move, so they are dealt to tasks by number.
    """
    sold = star.items.groupBy("seller_id", "product_id").agg(
        F.count("*").alias("units"), F.sum(line_value()).alias("value")
    )
    answer = sold.join(star.products, "product_id").select(
        F.col("seller_id").alias("case_id"), "product_id", "units", "value", "product_category_name"
    )
    return dealt(stored(answer, "answers"), ["case_id", "product_id"], rows_per_task)


def gold_rows(answer: DataFrame) -> DataFrame:
    cells = cells_of(answer, ["product_id", "units", "value", "product_category_name"])
    return answer.select("case_id", cells.alias("cells"))


def predicted_rows(answer: DataFrame) -> DataFrame:
    """By case number mod 7: same, 0.5 % off, 5 % off, rows missing, a column more, NULL filled, text changed."""
    fault = F.col("case_id") % 7
    first_products = F.col("product_id") % 100 < 2
    answer = answer.where((fault != 3) | ~first_products)
    value = (
        F.when(fault == 1, F.col("value").cast("double") * 1.005)
        .when((fault == 2) & first_products, F.col("value").cast("double") * 1.05)
        .otherwise(F.col("value").cast("double"))
    )
    brand = (
        F.when(fault == 5, F.coalesce("product_category_name", F.lit("none")))
        .when((fault == 6) & first_products, F.upper("product_category_name"))
        .otherwise(F.col("product_category_name"))
    )
    guess = answer.select(
        "case_id", F.col("product_id").alias("sku"), F.col("units").alias("n"), value.alias("total"), brand.alias("label")
    )
    columns = ["sku", "n", "total", "label"]
    plain, wider = cells_of(guess, columns), cells_of(guess, [*columns, "n"])
    return guess.select("case_id", F.when(fault == 4, wider).otherwise(plain).alias("cells"))


def compared_cases(star: Star) -> DataFrame:
    """Every seller, and a case without rows on either side for every tenth one."""
    numbers = star.base("supplier").select(F.col("s_suppkey").alias("case_id"))
    empty = numbers.where(F.col("case_id") % 10 == 0).select((F.col("case_id") + EMPTY_CASES_FROM).alias("case_id"))
    return numbers.unionByName(empty)


def both_sides(star: Star) -> tuple[DataFrame, DataFrame]:
    answer = gold_answer(star)
    return gold_rows(answer), predicted_rows(answer)


def resultset_compare(star: Star) -> DataFrame:
    return compare_results(compared_cases(star), *both_sides(star))


def resultset_compare_trimmed(star: Star) -> DataFrame:
    return compare_results(compared_cases(star), *both_sides(star), trim=True)


def resultset_exact_diff(star: Star) -> DataFrame:
    return exact_difference(*both_sides(star))


def eval_reason_rollup(star: Star) -> DataFrame:
    """Cases per first reason."""
    return resultset_compare(star).groupBy("reason").agg(F.count("*").alias("n_cases")).orderBy("reason")
