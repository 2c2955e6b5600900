"""Revenue, order value and item rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numeric import count_when, mean_of, percent, rounded, year_month
from tallyhouse.operators.picking import top_k
from tallyhouse.operators.shares import share_of_group, share_of_small_group
from tallyhouse.plans.grain import (
    line_value,
    category_sales,
    delivered_orders,
    order_category_lines,
    order_customers,
    order_totals,
    product_sales,
)
from tallyhouse.plans.star import Star

CATEGORY = "brand_9"
STATE = "NATION_3"
YEAR = 1997


def in_category(star: Star, english_name: str) -> DataFrame:
    return star.categories.where(F.col("english_name") == english_name)


# -- products and categories ------------------------------------------------------------


def e01_top_products_in_category(star: Star, category: str = CATEGORY) -> DataFrame:
    sold = product_sales(star).join(in_category(star, category), "product_id")
    return top_k(
        sold.select("product_id", F.col("n_items").alias("n_sold")), 5, F.desc("n_sold"), F.asc("product_id")
    )


def m04_top_categories_revenue(star: Star) -> DataFrame:
    top = top_k(category_sales(star, "english_name"), 5, F.desc_nulls_first("revenue"), F.asc_nulls_last("category"))
    return top.select("category", rounded(F.col("revenue"), 2).alias("revenue"))


def ex02_item_value_by_category(star: Star) -> DataFrame:
    value = category_sales(star, "best_name").select(
        "category", mean_of(F.col("revenue"), F.col("n_items"), 2).alias("avg_order_value")
    )
    return top_k(value, 20, F.desc_nulls_first("avg_order_value"), F.asc_nulls_last("category"))


def ex15_top_categories_by_items(star: Star) -> DataFrame:
    counted = category_sales(star, "best_name").select("category", F.col("n_items").alias("item_count"))
    return top_k(counted, 5, F.desc("item_count"), F.asc_nulls_last("category"))


def h07_multi_category_order_rate(star: Star) -> DataFrame:
    """Share of orders with two or more named categories, among multi-item orders only."""
    baskets = (
        order_category_lines(star, "english_name")
        .groupBy("order_id")
        .agg(F.sum("n_items").alias("n_items"), F.count("category").alias("n_categories"))
        .where(F.col("n_items") >= 2)
        .join(star.orders.select("order_id"), "order_id")
    )
    return baskets.agg(percent(count_when(F.col("n_categories") >= 2), F.count("*")).alias("pct_multi_category"))


def denominator_pattern_category_count(star: Star) -> DataFrame:
    """The same ratio on raw category names."""
    baskets = (
        order_category_lines(star, "raw_name")
        .groupBy("order_id")
        .agg(F.sum("n_items").alias("n_items"), F.count("category").alias("n_categories"))
        .where(F.col("n_items") > 1)
    )
    return baskets.agg(percent(count_when(F.col("n_categories") >= 2), F.count("*")).alias("pct"))


def h08_top_state_category_revenue(star: Star) -> DataFrame:
    """Best (state, category) pairs; untranslated and unclassified form the NULL category."""
    pairs = (
        order_category_lines(star, "english_name")
        .join(order_customers(star), "order_id")
        .groupBy("customer_state", "category")
        .agg(F.sum("revenue").alias("revenue"))
    )
    top = top_k(
        pairs, 5, F.desc_nulls_first("revenue"), F.asc_nulls_last("customer_state"), F.asc_nulls_last("category")
    )
    return top.select("customer_state", "category", rounded(F.col("revenue"), 2).alias("revenue"))


# -- customers and places ---------------------------------------------------------------


def h01_average_lifetime_value(star: Star) -> DataFrame:
    spend = (
        order_totals(star)
        .join(order_customers(star), "order_id")
        .groupBy("customer_unique_id")
        .agg(F.sum("order_total").alias("customer_total"))
    )
    return spend.agg(mean_of(F.sum("customer_total"), F.count("*"), 2).alias("avg_ltv"))


def order_value_by_state(star: Star) -> DataFrame:
    return (
        order_totals(star)
        .join(order_customers(star), "order_id")
        .groupBy("customer_state")
        .agg(
            F.sum("order_total").alias("revenue"),
            F.sum("n_items").alias("n_items"),
            F.count("*").alias("n_orders"),
        )
    )


def m03_average_order_value_by_state(star: Star) -> DataFrame:
    value = order_value_by_state(star).select(
        "customer_state", mean_of(F.col("revenue"), F.col("n_orders"), 2).alias("avg_gmv")
    )
    return top_k(value, 5, F.desc_nulls_first("avg_gmv"), F.asc("customer_state"))


def exl08_order_value_by_state_with_n(star: Star) -> DataFrame:
    value = order_value_by_state(star).select(
        "customer_state", mean_of(F.col("revenue"), F.col("n_orders"), 2).alias("avg_gmv"), "n_orders"
    )
    return top_k(value, 5, F.desc_nulls_first("avg_gmv"), F.asc("customer_state"))


def ex01_revenue_by_state(star: Star) -> DataFrame:
    top = top_k(order_value_by_state(star), 27, F.desc_nulls_first("revenue"), F.asc("customer_state"))
    return top.select("customer_state", rounded(F.col("revenue"), 2).alias("revenue"))


def ex05_basket_size_by_state(star: Star) -> DataFrame:
    delivered = star.orders.where(F.col("order_status") == "delivered").select("order_id", "customer_id")
    size = (
        order_totals(star)
        .join(delivered, "order_id")
        .join(star.customers, "customer_id")
        .groupBy("customer_state")
        .agg(mean_of(F.sum("n_items"), F.count("*"), 2).alias("avg_items"))
    )
    return top_k(size, 5, F.desc_nulls_first("avg_items"), F.asc("customer_state"))


# -- months -----------------------------------------------------------------------------


def monthly_order_value(totals: DataFrame, orders: DataFrame) -> DataFrame:
    month = year_month(F.col("order_purchase_timestamp")).alias("ym")
    return (
        totals.join(orders.select("order_id", "order_purchase_timestamp"), "order_id")
        .groupBy(month)
        .agg(
            mean_of(F.sum("order_total"), F.count("*"), 2).alias("avg_order_value"),
            F.count("*").alias("n_orders"),
        )
        .orderBy("ym")
    )


def h09_monthly_average_order_value(star: Star) -> DataFrame:
    return monthly_order_value(order_totals(star), star.orders)


def exl16_monthly_aov_category(star: Star, category: str = CATEGORY) -> DataFrame:
    """One category, delivered orders: items are summed per order, then joined for the month."""
    totals = (
        star.items.join(in_category(star, category), "product_id")
        .groupBy("order_id")
        .agg(F.sum(line_value()).alias("order_total"))
    )
    return monthly_order_value(totals, delivered_orders(star))


# -- sellers ----------------------------------------------------------------------------


def seller_sales(star: Star) -> DataFrame:
    sold = star.items.groupBy("seller_id").agg(F.sum(line_value()).alias("revenue"), F.count("*").alias("items_sold"))
    return sold.join(star.sellers, "seller_id")


def m10_top_sellers_revenue(star: Star) -> DataFrame:
    top = top_k(seller_sales(star), 10, F.desc_nulls_first("revenue"), F.asc("seller_id"))
    return top.select("seller_id", rounded(F.col("revenue"), 2).alias("revenue"))


def ex03_top_sellers_by_items(star: Star) -> DataFrame:
    return top_k(seller_sales(star).select("seller_id", "items_sold"), 5, F.desc("items_sold"), F.asc("seller_id"))


def h03_top_sellers_states_served(star: Star) -> DataFrame:
    """Distinct buyer states per seller; every step works on distinct pairs."""
    states = (
        star.items.select("order_id", "seller_id")
        .distinct()
        .join(order_customers(star).select("order_id", "customer_state"), "order_id")
        .select("seller_id", "customer_state")
        .distinct()
        .groupBy("seller_id")
        .agg(F.count("customer_state").alias("n_states"))
        .join(star.sellers.select("seller_id"), "seller_id")
    )
    return top_k(states, 5, F.desc("n_states"), F.asc("seller_id"))


def ex11_sellers_by_categories(star: Star, min_items: int = 600) -> DataFrame:
    per_category = (
        star.items.groupBy("seller_id", "product_id")
        .agg(F.count("*").alias("n_items"))
        .join(star.categories, "product_id")
        .groupBy("seller_id", "english_name")
        .agg(F.sum("n_items").alias("n_items"))
    )
    per_seller = (
        per_category.groupBy("seller_id")
        .agg(F.sum("n_items").alias("n_items"), F.count("english_name").alias("n_categories"))
        .where(F.col("n_items") >= min_items)
        .join(star.sellers.select("seller_id"), "seller_id")
        .select("seller_id", "n_categories")
    )
    return top_k(per_seller, 5, F.desc("n_categories"), F.asc("seller_id"))


def ex13_sellers_4hop_date_range(
    star: Star, state: str = STATE, category: str = CATEGORY, year: int = YEAR
) -> DataFrame:
    placed = F.col("order_purchase_timestamp")
    in_year = (placed >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (
        placed < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")
    )
    buyers = order_customers(star).where(in_year & (F.col("customer_state") == state)).select("order_id")
    sold = (
        star.items.join(in_category(star, category), "product_id")
        .groupBy("order_id", "seller_id")
        .agg(F.count("*").alias("n_items"))
        .join(buyers, "order_id")
        .groupBy("seller_id")
        .agg(F.sum("n_items").alias("items_sold"))
        .join(star.sellers.select("seller_id"), "seller_id")
    )
    return top_k(sold, 3, F.desc("items_sold"), F.asc("seller_id"))


def ex14_seller_share_in_state(star: Star) -> DataFrame:
    sold = seller_sales(star).select("seller_state", "seller_id", "items_sold")
    shares = share_of_group(sold, "seller_state", "items_sold", "pct_of_state_items")
    return shares.orderBy(F.asc_nulls_last("seller_state"), F.desc("items_sold"), F.asc("seller_id"))


# -- payments ---------------------------------------------------------------------------


def e03_payment_methods_in_category(star: Star, category: str = CATEGORY) -> DataFrame:
    """Payment rows times category items per order, without forming the pairs."""
    items = (
        star.items.join(in_category(star, category), "product_id")
        .groupBy("order_id")
        .agg(F.count("*").alias("n_items"))
    )
    paid = star.payments.groupBy("order_id", "payment_type").agg(F.count("*").alias("n_payments"))
    return (
        paid.join(star.orders.select("order_id"), "order_id")
        .join(items, "order_id")
        .groupBy("payment_type")
        .agg(F.sum(F.col("n_payments") * F.col("n_items")).alias("n"))
        .orderBy(F.desc("n"), "payment_type")
    )


def h05_payment_share_top5_categories(star: Star) -> DataFrame:
    """Payment value by method in the five best-selling categories, and its share there.

    Every payment counts once per category item of its order, as the joined rows would.
    """
    best = top_k(
        category_sales(star, "best_name"), 5, F.desc_nulls_first("revenue"), F.asc_nulls_last("category")
    ).select(F.col("category").alias("best_name"))
    products = star.categories.join(best, "best_name", "left_semi")
    lines = order_category_lines(star, "best_name", products)
    paid = star.payments.groupBy("order_id", "payment_type").agg(F.sum("payment_value").alias("paid"))
    value = (
        lines.join(star.orders.select("order_id"), "order_id")
        .join(paid, "order_id")
        .groupBy("category", "payment_type")
        .agg(F.sum(F.col("paid") * F.col("n_items")).alias("payment_value"))
    )
    return value.select(
        "category",
        "payment_type",
        rounded(F.col("payment_value"), 2).alias("payment_value"),
        share_of_small_group("category", "payment_value").alias("payment_share_pct"),
    ).orderBy("category", F.desc("payment_share_pct"), "payment_type")


def m09_average_payment_by_type(star: Star) -> DataFrame:
    return (
        star.payments.groupBy("payment_type")
        .agg(mean_of(F.sum("payment_value"), F.count("*"), 2).alias("avg_value"), F.count("*").alias("n"))
        .orderBy(F.desc("avg_value"), "payment_type")
    )


def ex10_total_payment_by_type(star: Star) -> DataFrame:
    return (
        star.payments.groupBy("payment_type")
        .agg(rounded(F.sum("payment_value"), 2).alias("total_value"), F.count("*").alias("n"))
        .orderBy(F.desc("total_value"), "payment_type")
    )


def payment_value_spread(star: Star) -> DataFrame:
    """Extremes and spread of payment values per method."""
    value = F.col("payment_value").cast("double")
    return (
        star.payments.groupBy("payment_type")
        .agg(
            F.min("payment_value").cast("double").alias("min_value"),
            F.max("payment_value").cast("double").alias("max_value"),
            F.round(F.stddev(value), 4).alias("stddev_value"),
            F.round(F.variance(value), 2).alias("variance_value"),
        )
        .orderBy("payment_type")
    )


# -- named metrics and plain samples ----------------------------------------------------


def metric_catalog(star: Star) -> DataFrame:
    """The named metrics, one row each. Revenue excludes freight, order value includes it."""
    def metric(name: str, rows: DataFrame, value) -> DataFrame:
        return rows.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")

    return (
        metric("revenue", star.items, F.sum("price"))
        .unionByName(metric("order_count", star.orders, F.countDistinct("order_id")))
        .unionByName(metric("customer_count", star.customers, F.countDistinct("customer_unique_id")))
        .unionByName(
            metric("average_order_value", order_totals(star), F.round(F.sum("order_total") / F.count("*"), 4))
        )
        .unionByName(metric("review_score", star.reviews, F.round(F.avg("review_score"), 4)))
    )


def order_totals_report(star: Star) -> DataFrame:
    return order_totals(star).select("order_id", rounded(F.col("order_total"), 2).alias("total_value"))


def sample_filter_limit(star: Star) -> DataFrame:
    return top_k(star.orders.where(F.col("order_status") == "delivered"), 10, F.asc("order_id"))


def sample_join_projection(star: Star) -> DataFrame:
    joined = star.orders.join(star.customers, "customer_id")
    return top_k(joined.select("order_id", "customer_city", "order_status"), 5, F.asc("order_id"))


def sample_state_counts(star: Star) -> DataFrame:
    counted = star.customers.groupBy("customer_state").agg(F.count("*").alias("count"))
    return top_k(counted, 5, F.desc("count"), F.asc("customer_state"))


def sample_item_total(star: Star) -> DataFrame:
    lines = star.items.select(
        "order_id",
        "order_item_id",
        F.col("price").cast("double").alias("price"),
        F.col("freight_value").cast("double").alias("freight_value"),
        line_value().cast("double").alias("total"),
    )
    return top_k(
        lines, 5, F.asc("order_id"), F.asc("order_item_id"), F.asc("price"), F.asc("freight_value")
    )


def sample_payment_totals(star: Star) -> DataFrame:
    return star.payments.groupBy("payment_type").agg(
        F.count("*").alias("count"), F.sum("payment_value").cast("double").alias("total")
    )
