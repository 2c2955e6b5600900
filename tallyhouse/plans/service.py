"""Delivery punctuality and review scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numeric import count_when, mean_of, percent, rounded, whole_days
from tallyhouse.operators.picking import first_per_key, top_k
from tallyhouse.plans.counting import row_count
from tallyhouse.plans.grain import (
    is_late,
    is_on_time,
    delivered_orders,
    order_category_lines,
    order_reviews,
    order_totals,
)
from tallyhouse.plans.star import Star


def e06_late_orders_count(star: Star) -> DataFrame:
    return row_count(delivered_orders(star).where(is_late()), "count")


def m02_on_time_rate(star: Star) -> DataFrame:
    return delivered_orders(star).agg(percent(count_when(is_on_time()), F.count("*")).alias("pct_on_time"))


def m11_on_time_rate_overall(star: Star) -> DataFrame:
    return m02_on_time_rate(star)


def days_by_state(star: Star, name: str) -> DataFrame:
    arrived = star.orders.where(
        (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()
    )
    days = whole_days(F.col("order_delivered_customer_date"), F.col("order_purchase_timestamp"))
    return (
        arrived.select("customer_id", days.alias("days"))
        .join(star.customers.select("customer_id", "customer_state"), "customer_id")
        .groupBy("customer_state")
        .agg(rounded(F.avg("days"), 2).alias(name))
    )


def m01_slowest_delivery_states(star: Star) -> DataFrame:
    return top_k(days_by_state(star, "avg_days"), 5, F.desc_nulls_first("avg_days"), F.asc("customer_state"))


def exl05_delivery_days_by_state(star: Star) -> DataFrame:
    return top_k(
        days_by_state(star, "avg_delivery_days"), 27, F.desc_nulls_first("avg_delivery_days"), F.asc("customer_state")
    )


def h04_worst_late_rate_categories(star: Star, min_orders: int = 600) -> DataFrame:
    """Late items over distinct orders per category.

    Numerator and denominator have different grains, so the rate may exceed 100 %.
    """
    rates = (
        order_category_lines(star, "best_name")
        .join(delivered_orders(star), "order_id")
        .groupBy("category")
        .agg(
            F.sum(F.when(is_late(), F.col("n_items")).otherwise(0)).alias("late_items"),
            F.count("*").alias("n_delivered_orders"),
        )
        .where(F.col("n_delivered_orders") >= min_orders)
        .select(
            "category",
            percent(F.col("late_items"), F.col("n_delivered_orders")).alias("late_delivery_rate_pct"),
            "n_delivered_orders",
        )
    )
    return top_k(
        rates, 5, F.desc("late_delivery_rate_pct"), F.desc("n_delivered_orders"), F.asc_nulls_last("category")
    )


def h06_review_on_time_vs_late(star: Star) -> DataFrame:
    status = F.when(is_on_time(), "on_time").otherwise("late").alias("delivery_status")
    return (
        order_reviews(star)
        .join(delivered_orders(star), "order_id")
        .groupBy(status)
        .agg(
            mean_of(F.sum("score_sum"), F.sum("n_reviews"), 3).alias("avg_score"),
            F.sum("n_reviews").alias("n"),
        )
        .orderBy("delivery_status")
    )


def h10_average_review_lag_days(star: Star) -> DataFrame:
    arrived = star.orders.where(
        (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()
    ).select("order_id", "order_delivered_customer_date")
    lag = whole_days(F.col("review_creation_date"), F.col("order_delivered_customer_date"))
    return (
        star.reviews.where(F.col("review_creation_date").isNotNull())
        .join(arrived, "order_id")
        .agg(rounded(F.avg(lag), 2).alias("avg_review_lag_days"), F.count("*").alias("n"))
    )


def category_reviews(star: Star, name: str) -> DataFrame:
    """Every review counts once per category item of its order."""
    return (
        order_category_lines(star, name)
        .join(order_reviews(star), "order_id")
        .groupBy("category")
        .agg(
            F.sum(F.col("score_sum") * F.col("n_items")).alias("score_sum"),
            F.sum(F.col("n_reviews") * F.col("n_items")).alias("n_reviews"),
        )
    )


def m05_worst_reviewed_categories(star: Star, min_reviews: int = 1500) -> DataFrame:
    scores = (
        category_reviews(star, "english_name")
        .where(F.col("category").isNotNull() & (F.col("n_reviews") >= min_reviews))
        .select("category", mean_of(F.col("score_sum"), F.col("n_reviews"), 2).alias("avg_score"), "n_reviews")
    )
    return top_k(scores, 5, F.asc("avg_score"), F.asc("category"))


def exl15_top_categories_by_reviews(star: Star, min_reviews: int = 1500) -> DataFrame:
    most = top_k(
        category_reviews(star, "best_name").where(F.col("n_reviews") >= min_reviews),
        5,
        F.desc("n_reviews"),
        F.asc_nulls_last("category"),
    )
    return most.select("category", mean_of(F.col("score_sum"), F.col("n_reviews"), 2).alias("avg_score"), "n_reviews")


def ex06_latest_review_per_order(star: Star) -> DataFrame:
    latest = first_per_key(
        star.reviews, ["order_id"], [F.desc_nulls_first("review_creation_date"), F.desc("review_id")]
    )
    return latest.agg(F.avg("review_score").alias("avg_review_score"))


def ex12_latest_review_per_customer(star: Star) -> DataFrame:
    reviewed = star.reviews.join(star.orders.select("order_id", "customer_id"), "order_id")
    latest = first_per_key(
        reviewed, ["customer_id"], [F.desc_nulls_first("review_creation_date"), F.desc("review_id")]
    )
    return latest.agg(F.avg("review_score").alias("avg_review_score"))


def ex08_review_by_basket_type(star: Star) -> DataFrame:
    basket = F.when(F.col("n_items") == 1, "single_item").otherwise("multi_item").alias("basket_type")
    sizes = order_totals(star).join(star.orders.select("order_id"), "order_id").select("order_id", "n_items")
    return (
        order_reviews(star)
        .join(sizes, "order_id")
        .groupBy(basket)
        .agg(
            mean_of(F.sum("score_sum"), F.sum("n_reviews"), 3).alias("avg_score"),
            F.sum("n_reviews").alias("n"),
        )
        .orderBy("basket_type")
    )
