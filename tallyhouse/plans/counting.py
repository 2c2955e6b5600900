"""Row counts, distinct counts and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numeric import count_when, percent, rounded, year_month
from tallyhouse.operators.picking import top_k
from tallyhouse.operators.shares import share_of_all
from tallyhouse.plans.grain import order_customers
from tallyhouse.plans.star import Star


def row_count(rows: DataFrame, name: str = "n") -> DataFrame:
    return rows.agg(F.count("*").alias(name))


def e04_unique_customers(star: Star) -> DataFrame:
    return star.customers.agg(F.countDistinct("customer_unique_id").alias("count"))


def e05_average_review_score(star: Star) -> DataFrame:
    return star.reviews.agg(rounded(F.avg("review_score"), 4).alias("round"))


def e07_total_orders(star: Star) -> DataFrame:
    return row_count(star.orders)


def e08_unique_customers_named(star: Star) -> DataFrame:
    return star.customers.agg(F.countDistinct("customer_unique_id").alias("n"))


def e09_distinct_categories(star: Star) -> DataFrame:
    return star.products.agg(F.countDistinct("product_category_name").alias("n"))


def e10_total_sellers(star: Star) -> DataFrame:
    return row_count(star.sellers)


def e11_total_payments(star: Star) -> DataFrame:
    return row_count(star.payments)


def e12_total_reviews(star: Star) -> DataFrame:
    return row_count(star.reviews)


def e15_orders_by_status(star: Star) -> DataFrame:
    return star.orders.groupBy("order_status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "order_status")


def e16_total_line_items(star: Star) -> DataFrame:
    return row_count(star.items)


def people_by(star: Star, place: str, k: int, name: str) -> DataFrame:
    people = star.customers.groupBy(place).agg(F.countDistinct("customer_unique_id").alias(name))
    return top_k(people, k, F.desc(name), F.asc(place))


def e02_top_cities_by_customers(star: Star) -> DataFrame:
    return people_by(star, "customer_city", 10, "n_customers")


def e13_top_states_by_customers(star: Star) -> DataFrame:
    return people_by(star, "customer_state", 5, "n")


def m07_top_cities_unique_customers(star: Star) -> DataFrame:
    return people_by(star, "customer_city", 10, "n_unique_customers")


def e14_top_states_by_sellers(star: Star) -> DataFrame:
    per_state = star.sellers.groupBy("seller_state").agg(F.count("*").alias("n"))
    return top_k(per_state, 5, F.desc("n"), F.asc("seller_state"))


def orders_per_person(star: Star) -> DataFrame:
    return star.customers.groupBy("customer_unique_id").agg(F.countDistinct("customer_id").alias("n_orders"))


def h02_repeat_customer_rate(star: Star) -> DataFrame:
    return orders_per_person(star).agg(
        percent(count_when(F.col("n_orders") > 1), F.count("*")).alias("repeat_pct")
    )


def m13_orders_per_customer_distribution(star: Star) -> DataFrame:
    return orders_per_person(star).groupBy("n_orders").agg(F.count("*").alias("n_customers")).orderBy("n_orders")


def ex09_orders_per_seller_distribution(star: Star) -> DataFrame:
    per_seller = star.items.groupBy("seller_id").agg(F.countDistinct("order_id").alias("n_orders"))
    return per_seller.groupBy("n_orders").agg(F.count("*").alias("n_sellers")).orderBy("n_orders")


def m06_payment_method_share(star: Star) -> DataFrame:
    per_type = star.payments.groupBy("payment_type").agg(F.count("*").alias("n"))
    return per_type.withColumn("pct", share_of_all(per_type, "n")).orderBy(F.desc("n"), "payment_type")


def m08_monthly_order_count(star: Star) -> DataFrame:
    month = year_month(F.col("order_purchase_timestamp")).alias("ym")
    return star.orders.groupBy(month).agg(F.count("*").alias("n")).orderBy("ym")


def m12_review_score_distribution(star: Star) -> DataFrame:
    return star.reviews.groupBy("review_score").agg(F.count("*").alias("n")).orderBy("review_score")


def ex04_canceled_before_approval(star: Star) -> DataFrame:
    canceled = star.orders.where((F.col("order_status") == "canceled") & F.col("order_approved_at").isNull())
    return row_count(canceled, "canceled_before_approval")


def exl04_unique_customers_in_year(star: Star, year: int = 1997) -> DataFrame:
    placed = F.col("order_purchase_timestamp")
    in_year = (placed >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (
        placed < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")
    )
    return order_customers(star).where(in_year).agg(
        F.countDistinct("customer_unique_id").alias("unique_customers")
    )


def order_date_parts(star: Star) -> DataFrame:
    """Orders per calendar part; day of week counts from Sunday = 0."""
    placed = F.col("order_purchase_timestamp")
    return (
        star.orders.groupBy(
            F.year(placed).alias("year"),
            F.month(placed).alias("month"),
            (F.dayofweek(placed) - 1).alias("dow"),
        )
        .agg(F.count("*").alias("n"))
        .orderBy("year", "month", "dow")
    )


def dataset_max_date(star: Star) -> DataFrame:
    latest = F.max("order_purchase_timestamp").cast("date").cast("string")
    return star.orders.agg(latest.alias("max_date"))
