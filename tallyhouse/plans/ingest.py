"""Loading and conforming the tables, and audits of what was loaded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.numeric import rounded
from tallyhouse.operators.audits import join_rows, orphans
from tallyhouse.operators.picking import capped, first_per_key
from tallyhouse.plans.grain import product_sales
from tallyhouse.plans.star import Star
from tallyhouse.schema import MINIMUM_ROWS, SOFT_FOREIGN_KEYS
from tallyhouse.session import scratch_dir
from tallyhouse.sources.csv_files import lenient_timestamp, load_table, read_table, scan_csv, write_csv
from tallyhouse.sources.tables import full_refresh

# -- CSV --------------------------------------------------------------------------------


def ingest_csv_scan(star: Star) -> DataFrame:
    """Reviews with whole documents as message, out to CSV and back through the loader."""
    reviews = star.base("documents").select(
        F.col("doc_id").cast("string").alias("review_id"),
        F.concat(F.lit("o"), F.col("doc_id")).alias("order_id"),
        (F.col("doc_id") % 5 + 1).cast("string").alias("review_score"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit('say "'), F.col("lang"), F.lit('", twice'))).alias(
            "review_comment_title"
        ),
        # Blanks and a line break at the ends belong to the cell.
        F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("\n  "), "text", F.lit("  \n"))).otherwise(F.col("text")).alias(
            "review_comment_message"
        ),
    )
    path = write_csv(reviews, scratch_dir(star.spark, "csv-reviews"))
    return read_table(star.spark, path, "order_reviews").select(
        "review_id",
        "order_id",
        "review_score",
        "review_comment_title",
        F.md5("review_comment_message").alias("message_md5"),
        F.length("review_comment_message").alias("message_chars"),
    )


def ingest_lenient_cast(star: Star) -> DataFrame:
    """Measures written as floats, blanks and words."""
    size = F.col("p_size")
    cell = (
        F.when(F.col("p_partkey") % 7 == 1, F.lit(""))
        .when(F.col("p_partkey") % 7 == 2, F.lit("n/a"))
        .when(F.col("p_partkey") % 7 == 3, F.concat(size, F.lit(".9")))
        .when(F.col("p_partkey") % 7 == 4, F.concat(F.lit("-"), size, F.lit(".7")))
        .when(F.col("p_partkey") % 7 == 5, F.concat(size, F.lit("e1")))
        .when(F.col("p_partkey") % 21 == 6, F.concat(size, F.lit("d")))
        .when(F.col("p_partkey") % 21 == 13, F.concat(size, F.lit("f")))
        .otherwise(size.cast("string"))
    )
    products = star.base("part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.when(F.col("p_partkey") % 40 != 0, F.col("p_brand")).alias("product_category_name"),
        cell.alias("product_weight_g"),
    )
    path = write_csv(products, scratch_dir(star.spark, "csv-products"))
    return read_table(star.spark, path, "products")


def ingest_timestamp_formats(star: Star) -> DataFrame:
    """Two accepted timestamp forms; anything else becomes NULL."""
    placed, key = F.col("o_orderdate"), F.col("o_orderkey")
    cell = (
        F.when(key % 5 == 0, F.date_format(F.expr("o_orderdate + interval 1 hour"), "yyyy-MM-dd HH:mm:ss"))
        .when(key % 5 == 1, F.date_format(placed, "yyyy-MM-dd"))
        .when(key % 5 == 2, F.date_format(placed, "dd/MM/yyyy"))
        .when(key % 5 == 3, F.lit("2018-02-30"))
        .otherwise(F.lit(""))
    )
    rows = star.base("orders").select(
        key.cast("string").alias("order_id"), cell.alias("order_purchase_timestamp")
    )
    path = write_csv(rows, scratch_dir(star.spark, "csv-orders"))
    parsed = lenient_timestamp(F.col("order_purchase_timestamp"))
    return scan_csv(star.spark, path).select(
        "order_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("order_purchase_timestamp")
    )


def ingest_table_load(star: Star) -> DataFrame:
    """Payments with every key repeated, in the file and in a later file: the first row of each key is stored."""
    key = F.col("o_orderkey")
    first = star.base("orders").select(
        key.cast("string").alias("order_id"),
        F.concat((key % 3 + 1).cast("string"), F.lit(".0")).alias("payment_sequential"),
        F.concat(F.lit(" \n"), "o_orderpriority").alias("payment_type"),
        F.when(key % 4 != 0, F.lit("12d")).otherwise("3").alias("payment_installments"),
        F.col("o_totalprice").cast("decimal(10,2)").cast("string").alias("payment_value"),
    )
    late = {"payment_type": F.lit("late"), "payment_value": F.lit("0.01")}
    second = [late.get(c, F.col(c)).alias(c) for c in first.columns]
    folder = scratch_dir(star.spark, "csv-payments")
    # Both rows of a key stand in one file, the right one first; then come files of late rows only.
    write_csv(first.select(F.inline(F.array(F.struct(*first.columns), F.struct(*second)))), f"{folder}/1")
    write_csv(first.select(*second), f"{folder}/2")
    return load_table(star.spark, [f"{folder}/1", f"{folder}/2"], "order_payments", f"{folder}/stored")


# -- keys, refresh, geography -----------------------------------------------------------


def ingest_first_wins_dedupe(star: Star) -> DataFrame:
    """One row per (order, line): the first in arrival order."""
    arrival = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    lines = star.base("lineitem").select("l_orderkey", "l_linenumber", *arrival)
    winners = first_per_key(lines, ["l_orderkey", "l_linenumber"], [F.asc(c) for c in arrival])
    return winners.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def geolocation_by_zip(star: Star) -> DataFrame:
    """One row per zip: mean position, most frequent city and state, the smallest on a tie.

    Raw rows are summed per place once; all the rest works on those sums, laid out by zip.
    """
    places = (
        star.geolocation.groupBy("zip", "city", "state")
        .agg(
            F.sum("lat").alias("lat_sum"), F.count("lat").alias("lat_n"),
            F.sum("lng").alias("lng_sum"), F.count("lng").alias("lng_n"), F.count("*").alias("n"),
        )
        .repartition("zip")
    )

    def often(name: str) -> Column:
        return F.sum("n").over(Window.partitionBy("zip", name))

    def commonest(name: str) -> Column:
        known = F.col(name).isNotNull()
        return F.min_by(F.when(known, F.col(name)), F.when(known, F.struct(-F.col(f"{name}_n"), name))).alias(name)

    return (
        places.withColumns({"city_n": often("city"), "state_n": often("state")})
        .groupBy("zip")
        .agg(
            rounded(F.sum("lat_sum") / F.sum("lat_n"), 6).alias("lat"),
            rounded(F.sum("lng_sum") / F.sum("lng_n"), 6).alias("lng"),
            commonest("city"), commonest("state"),
        )
    )


def ingest_full_refresh(star: Star) -> DataFrame:
    """The zip table, stored over an older version of itself."""
    path = scratch_dir(star.spark, "zip-table")
    stale = star.geolocation.select(
        "zip", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng"), F.lit("stale").alias("city"), F.lit("XX").alias("state")
    )
    full_refresh(stale, path)
    return full_refresh(geolocation_by_zip(star), path)


# -- audits -----------------------------------------------------------------------------


def stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_row_counts(star: Star) -> DataFrame:
    """Rows of every table against the minimum a complete load must reach."""
    tables = {
        "customers": star.customers,
        "sellers": star.sellers,
        "products": star.products,
        "product_category_translation": star.translation,
        "orders": star.orders,
        "order_items": star.items,
        "order_payments": star.payments,
        "order_reviews": star.reviews,
        "geolocation": star.geolocation,
    }
    counted = [
        rows.agg(F.count("*").alias("n")).select(
            F.lit(name).alias("table_name"),
            "n",
            F.lit(MINIMUM_ROWS[name]).cast("long").alias("minimum"),
            (F.col("n") >= MINIMUM_ROWS[name]).cast("int").alias("ok"),
        )
        for name, rows in tables.items()
    ]
    return stacked(counted)


def geo_zip_join_safe(star: Star) -> DataFrame:
    """Rows of customers joined by zip: to the one-row-per-zip table and to the raw one."""
    customers = star.customers.agg(F.count("*").alias("n"))
    safe = join_rows(star.customers, "customer_zip_code_prefix", geolocation_by_zip(star), "zip", "n")
    raw = join_rows(star.customers, "customer_zip_code_prefix", star.geolocation, "zip", "n")
    labelled = [
        rows.select(F.lit(name).alias("joined_to"), F.col("n").alias("n_rows"))
        for name, rows in (("nothing", customers), ("geolocation_by_zip", safe), ("geolocation", raw))
    ]
    return stacked(labelled)


def fk_orphan_audit(star: Star) -> DataFrame:
    """Children without parent for every undeclared relationship.

    Reviews are keyed here so that some point at no order.
    """
    tables = {
        "orders": star.orders,
        "customers": star.customers,
        "order_items": star.items,
        "products": star.products,
        "sellers": star.sellers,
        "order_payments": star.payments,
        "order_reviews": star.base("events").select((F.col("event_id") * 2).alias("order_id")),
        "product_category_translation": star.translation,
    }
    return orphans(tables, SOFT_FOREIGN_KEYS)


def inner_join_drop_audit(star: Star) -> DataFrame:
    """What an INNER join to the English names would silently lose."""
    sales = product_sales(star).join(star.categories, "product_id")
    untranslated = F.col("english_name").isNull()
    return sales.agg(
        F.sum("n_items").alias("n_items"),
        F.sum(F.when(untranslated, F.col("n_items")).otherwise(0)).alias("n_items_lost"),
        rounded(F.sum(F.when(untranslated, F.col("revenue"))), 2).alias("revenue_lost"),
    )


def row_cap_with_flag(star: Star, cap: int = 1000) -> DataFrame:
    """Detail rows under a row cap, with a flag that tells whether rows were left out."""
    return capped(star.orders.select("order_id", "order_status"), cap, F.asc("order_id"))
