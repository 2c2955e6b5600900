"""Frames at the grain most queries need.

Facts are summed to a join key before they are joined, so the exchange carries one row per
key and input partition, and a key that holds a third of the table costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.plans.star import Star


def line_value() -> Column:
    return F.col("price") + F.col("freight_value")


def is_late() -> Column:
    return F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")


def is_on_time() -> Column:
    return F.col("order_delivered_customer_date") <= F.col("order_estimated_delivery_date")


def order_totals(star: Star) -> DataFrame:
    return star.items.groupBy("order_id").agg(
        F.sum(line_value()).alias("order_total"), F.count("*").alias("n_items")
    )


def product_sales(star: Star) -> DataFrame:
    return star.items.groupBy("product_id").agg(
        F.sum(line_value()).alias("revenue"), F.count("*").alias("n_items")
    )


def category_sales(star: Star, name: str) -> DataFrame:
    """Revenue and items per category; ``name`` picks the category column."""
    return (
        product_sales(star)
        .join(star.categories, "product_id")
        .groupBy(F.col(name).alias("category"))
        .agg(F.sum("revenue").alias("revenue"), F.sum("n_items").alias("n_items"))
    )


def order_category_lines(star: Star, name: str, categories: DataFrame | None = None) -> DataFrame:
    """Items and revenue per (order, category)."""
    chosen = star.categories if categories is None else categories
    return (
        star.items.join(chosen, "product_id")
        .groupBy("order_id", F.col(name).alias("category"))
        .agg(F.sum(line_value()).alias("revenue"), F.count("*").alias("n_items"))
    )


def order_reviews(star: Star) -> DataFrame:
    return star.reviews.groupBy("order_id").agg(
        F.sum("review_score").alias("score_sum"), F.count("*").alias("n_reviews")
    )


def delivered_orders(star: Star) -> DataFrame:
    """Orders delivered with both dates known."""
    return star.orders.where(
        (F.col("order_status") == "delivered")
        & F.col("order_delivered_customer_date").isNotNull()
        & F.col("order_estimated_delivery_date").isNotNull()
    )


def order_customers(star: Star) -> DataFrame:
    return star.orders.select("order_id", "customer_id", "order_purchase_timestamp").join(
        star.customers, "customer_id"
    )

