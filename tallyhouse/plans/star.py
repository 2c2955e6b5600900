"""The commerce star schema, shaped from the base tables.

Each property is a lazy view; Catalyst prunes whatever a query does not read.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.sources.tables import read_base

UNTRANSLATED_BRANDS = ("Brand#5", "Brand#15")


class Star:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def base(self, name: str) -> DataFrame:
        return read_base(self.spark, self.folder, name)

    @cached_property
    def customers(self) -> DataFrame:
        """One row per order; the person is ``customer_unique_id``."""
        zip_prefix = F.lpad((F.col("c_custkey") % 97).cast("string"), 5, "0")
        return (
            self.base("orders")
            .join(self.base("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.base("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.base("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("o_orderkey").alias("customer_id"),
                F.col("c_custkey").alias("customer_unique_id"),
                zip_prefix.alias("customer_zip_code_prefix"),
                F.concat("n_name", F.lit("/"), "c_mktsegment").alias("customer_city"),
                F.col("n_name").alias("customer_state"),
            )
        )

    @cached_property
    def sellers(self) -> DataFrame:
        return (
            self.base("supplier")
            .join(self.base("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.base("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("seller_id"),
                F.concat("n_name", F.lit("/"), "r_name").alias("seller_city"),
                F.col("n_name").alias("seller_state"),
            )
        )

    @cached_property
    def products(self) -> DataFrame:
        """Every fortieth product is unclassified."""
        return self.base("part").select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_partkey") % 40 != 0, F.col("p_brand")).alias("product_category_name"),
            F.col("p_size").alias("product_weight_g"),
        )

    @cached_property
    def translation(self) -> DataFrame:
        """English category names; not total."""
        return (
            self.base("part")
            .where(~F.col("p_brand").isin(*UNTRANSLATED_BRANDS))
            .select(F.col("p_brand").alias("product_category_name"))
            .distinct()
            .withColumn(
                "product_category_name_english",
                F.lower(F.replace("product_category_name", F.lit("#"), F.lit("_"))),
            )
        )

    @cached_property
    def orders(self) -> DataFrame:
        key, placed = F.col("o_orderkey"), F.col("o_orderdate")
        status = (
            F.when(F.col("o_orderstatus") == "F", "delivered")
            .when(F.col("o_orderstatus") == "O", "shipped")
            .otherwise("canceled")
        )
        hour_to_approve = F.expr("o_orderdate + interval 1 hour")
        hours_to_deliver = F.expr("o_orderdate + make_dt_interval(0, cast((o_orderkey * 7) % 700 as int))")
        days_promised = F.expr("o_orderdate + make_dt_interval(cast((o_orderkey * 13) % 60 as int))")
        arrived = (F.col("o_orderstatus") == "F") & (key % 100 != 0)
        return self.base("orders").select(
            key.alias("order_id"),
            key.alias("customer_id"),
            status.alias("order_status"),
            placed.alias("order_purchase_timestamp"),
            F.when(key % 50 != 0, hour_to_approve).alias("order_approved_at"),
            F.when(arrived, hours_to_deliver).alias("order_delivered_customer_date"),
            days_promised.alias("order_estimated_delivery_date"),
        )

    @cached_property
    def items(self) -> DataFrame:
        return self.base("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
            F.col("l_quantity").cast("decimal(10,2)").alias("freight_value"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        """One to three instalments of the same value per order."""
        kind = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "credit_card")
            .when(F.col("o_orderpriority") == "2-HIGH", "boleto")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "voucher")
            .when(F.col("o_orderpriority") == "5-LOW", "debit_card")
            .otherwise("not_defined")
        )
        return self.base("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.explode(F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("payment_sequential"),
            kind.alias("payment_type"),
            F.col("o_totalprice").cast("decimal(10,2)").alias("payment_value"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        """Two reviews per reviewed order."""
        events = self.base("events").select(
            F.col("event_id").alias("review_id"),
            (F.col("event_id") - F.col("event_id") % 2).alias("order_id"),
        )
        orders = self.base("orders").select(F.col("o_orderkey").alias("order_id"), "o_orderdate")
        return events.join(orders, "order_id").select(
            "review_id",
            "order_id",
            ((F.col("review_id") * 3 + F.col("order_id")) % 5 + 1).cast("int").alias("review_score"),
            F.expr("o_orderdate + make_dt_interval(0, cast((review_id * 11) % 900 as int))").alias(
                "review_creation_date"
            ),
        )

    @cached_property
    def geolocation(self) -> DataFrame:
        """Many rows per zip, no key."""
        return (
            self.base("customer")
            .join(self.base("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.lpad((F.col("c_custkey") % 97).cast("string"), 5, "0").alias("zip"),
                F.col("c_acctbal").alias("lat"),
                F.when(F.col("c_custkey") % 10 != 0, -F.col("c_acctbal") / 2).alias("lng"),
                F.col("n_name").alias("city"),
                F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("state"),
            )
        )

    @cached_property
    def categories(self) -> DataFrame:
        """Category of every product: raw name, English name or NULL, and the better of both."""
        return self.products.join(self.translation, "product_category_name", "left").select(
            "product_id",
            F.col("product_category_name").alias("raw_name"),
            F.col("product_category_name_english").alias("english_name"),
            F.coalesce("product_category_name_english", "product_category_name").alias("best_name"),
        )
