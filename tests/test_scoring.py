"""Grades, outcomes, costs, slugs, rubric graders, and the traps of the commerce questions."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import grading, rubric, sqltext, text
from tallyhouse.functions.numeric import percent, whole_days
from tallyhouse.plans import sales, service
from tallyhouse.plans.scoring import latest_runs
from tallyhouse.plans.star import Star


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "grades, expected",
    [(("NA", "NA"), "NA"), (("NA", "correct"), "correct"), (("flag", "correct"), "flag"), (("flag", "wrong"), "wrong")],
)
def test_worst_grade(spark, grades, expected):
    assert one(spark, grading.worst_grade(*[F.lit(g) for g in grades])) == expected


@pytest.mark.parametrize(
    "ex, wrong, flag, refused, late, crashed, expected",
    [
        (1, False, False, False, False, False, ("pass", "pass")),
        (1, False, True, False, False, False, ("pass", "review")),
        (1, True, False, False, False, False, ("fail", "fail")),
        (0, False, False, False, False, False, ("fail", "fail")),
        (1, False, False, True, False, False, ("error", "error")),
        (0, False, False, False, True, False, ("timeout", "fail")),
        (0, False, False, False, False, True, ("error", "fail")),
    ],
)
def test_outcome(spark, ex, wrong, flag, refused, late, crashed, expected):
    args = [F.lit(v) for v in (ex, wrong, flag, refused, late, crashed)]
    found = one(spark, F.struct(grading.status(args[0], args[1], *args[3:]), grading.outcome(*args)))
    assert tuple(found) == expected


def test_cost_of_known_and_unknown_models(spark):
    def cost(name):
        return one(spark, grading.token_cost(F.lit(name), F.lit(1_000_000), F.lit(500_000)))

    assert cost("gpt-4o-mini") == pytest.approx(0.45)
    assert cost("nobody") == 0.0


def test_slugs(spark):
    assert one(spark, text.run_slug(F.lit("baseline 4o-mini!"))) == "baseline_4o_mini"
    assert one(spark, text.run_id(F.lit("!!"), F.lit("20260101"))) == "20260101"
    assert one(spark, text.question_slug(F.lit("What are the top 5 cities per state?"))) == "5_cities_state"
    assert one(spark, text.question_slug(F.lit("How many orders?"))) == "how_many_orders"
    assert one(spark, text.question_slug(F.lit("??"))) == "case"
    ids = [one(spark, text.case_id(F.lit("e"), F.lit(n), F.lit("x"))) for n in (7, 123)]
    assert ids == ["e07_x", "e123_x"]


def test_rubric_blocks_and_ground_truth(spark):
    block = one(spark, text.rubric_block(F.lit(" a, b ; c;; ")))
    assert (block.required, block.spec, block.items) == (True, "a, b ; c;;", ["a, b", "c"])
    assert one(spark, text.rubric_block(F.lit("  "))).required is False
    shape = one(spark, text.ground_truth_shape(F.lit('{"rows": [[1.5]], "columns": []}')))
    assert tuple(shape) == ("table", 1, 1, "1.5")
    assert tuple(one(spark, text.ground_truth_shape(F.lit("[[1, 2], [3, 4]]")))) == ("rows", 2, 2, None)
    assert one(spark, text.ground_truth_shape(F.lit("12 orders"))).form == "raw"


def items(*values):
    return F.array(*[F.lit(v) for v in values]) if values else F.lit(None).cast("array<string>")


SQL = (
    "SELECT o.order_id, COUNT(DISTINCT i.product_id) FROM orders o LEFT JOIN order_items i ON o.order_id = i.order_id "
    "WHERE o.order_status = 'delivered' AND i.price >= 5 GROUP BY o.order_id LIMIT 50"
)


def test_graders(spark):
    sql, bare = F.lit(SQL), F.lower(F.lit(SQL))
    names = spark.createDataFrame([(SQL.lower(),)], "t string").select(sqltext.names_in_scope("t").alias("names"))
    tables = F.array(*[F.lit(t) for t in names.select(sqltext.table_names(F.col("names.refs"))).first()[0]])
    joins = sqltext.join_clauses(bare)
    qualified, plain = sqltext.prefixed_columns(bare), sqltext.plain_columns(bare)

    def table(*wanted):
        return one(spark, rubric.grade_table(items(*wanted), tables, qualified, plain))

    assert [table("orders.order_id", "order_items"), table("orders.order_id", "x.y"), table("x.y"), table()] == [
        "correct", "flag", "wrong", "NA",
    ]

    def filters(*wanted):
        return one(spark, rubric.grade_filters(items(*wanted), sqltext.shallowest_clause(sql, "where", sqltext.CLAUSE_ENDS), sql))

    assert [filters("order_status = 'delivered'", "x.price  >= 5".replace("x.", "i.")), filters("GROUP BY o.order_id")] == [
        "correct", "wrong",
    ]

    def aggregation(*wanted):
        return one(spark, rubric.grade_aggregation(items(*wanted), bare, sqltext.shallowest_clause(bare, "limit", [])))

    assert aggregation("COUNT", "DISTINCT ids", "GROUP BY order_id", "LIMIT 5") == "correct"
    assert aggregation("SUM", "COUNT") == "flag"
    assert aggregation("SUM(x)", "ORDER BY y") == "wrong"

    def join(*wanted):
        return one(spark, rubric.grade_join(items(*wanted), tables, joins))

    assert [join("orders LEFT JOIN order_items"), join("orders JOIN order_items"), join("a JOIN b"), join()] == [
        "correct", "flag", "correct", "NA",
    ]

    def operator(*wanted):
        return one(spark, rubric.grade_date_operator(items(*wanted), bare))

    assert [operator("x >= y"), operator("x < y; z >= y", "a < b"), operator("none"), operator("a > b")] == [
        "correct", "wrong", "NA", "wrong",
    ]
    day = F.lit("SELECT EXTRACT(DAY FROM a - b) FROM t")
    assert one(spark, rubric.grade_time_frame(F.lit("DATE_PART('day', a)"), day)) == "correct"
    assert one(spark, rubric.grade_time_frame(F.lit("TO_CHAR(a), date_part(b)"), day)) == "flag"


def test_latest_run_prefers_the_exact_id(spark):
    runs = spark.createDataFrame(
        [("base_1", datetime.datetime(2026, 1, 1)), ("base_2", datetime.datetime(2026, 2, 1)), ("base", datetime.datetime(2025, 1, 1))],
        "run_id string, started_at timestamp",
    )
    found = latest_runs(runs, ["Base!", "base_1", "base", "other"]).collect()
    assert [tuple(r) for r in found] == [("Base!", "base_2"), ("base_1", "base_1"), ("base", "base"), ("other", None)]
    assert latest_runs(runs.limit(0), ["base"]).first().run_id is None


def test_whole_days_truncate_toward_zero(spark):
    def days(a, b):
        return one(spark, whole_days(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")))

    assert days("2018-01-03 02:00:00", "2018-01-02 00:00:00") == 1
    assert days("2018-01-02 00:00:00", "2018-01-03 02:00:00") == -1
    assert days("2018-01-02 23:00:00", "2018-01-02 00:00:00") == 0


def test_percent_rounds_halves_up(spark):
    assert one(spark, percent(F.lit(1).cast("long"), F.lit(800).cast("long"))) == 0.13


@pytest.fixture
def shop(spark):
    """Two orders, one late; products unclassified and untranslated; two payments on one order."""
    star = Star(spark, "unused")
    at = datetime.datetime
    star.orders = spark.createDataFrame(
        [
            (1, 1, "delivered", at(2018, 1, 1), at(2018, 1, 1), at(2018, 1, 9), at(2018, 1, 5)),
            (2, 2, "delivered", at(2018, 2, 1), at(2018, 2, 1), None, at(2018, 2, 5)),
        ],
        "order_id long, customer_id long, order_status string, order_purchase_timestamp timestamp_ntz, "
        "order_approved_at timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
        "order_estimated_delivery_date timestamp_ntz",
    )
    star.items = spark.createDataFrame(
        [(1, 1, 10, 5, Decimal("1.00"), Decimal("0.50")), (1, 2, 11, 5, Decimal("2.00"), Decimal("0.00")),
         (1, 3, 10, 6, Decimal("1.00"), Decimal("0.50")), (2, 1, 12, 6, Decimal("9.00"), Decimal("1.00"))],
        "order_id long, order_item_id int, product_id long, seller_id long, price decimal(10,2), freight_value decimal(10,2)",
    )
    star.products = spark.createDataFrame(
        [(10, "livros"), (11, None), (12, "novo")], "product_id long, product_category_name string"
    )
    star.translation = spark.createDataFrame(
        [("livros", "books")], "product_category_name string, product_category_name_english string"
    )
    star.payments = spark.createDataFrame(
        [(1, 1, "card", Decimal("3.00")), (1, 2, "voucher", Decimal("2.50"))],
        "order_id long, payment_sequential int, payment_type string, payment_value decimal(10,2)",
    )
    return star


def test_missing_categories_form_one_group(shop):
    rows = [tuple(r) for r in sales.m04_top_categories_revenue(shop).collect()]
    assert rows == [(None, 12.0), ("books", 3.0)]
    named = [tuple(r) for r in sales.ex15_top_categories_by_items(shop).collect()]
    assert named == [("books", 2), ("novo", 1), (None, 1)]


def test_late_rate_may_exceed_a_hundred(shop):
    rows = [tuple(r) for r in service.h04_worst_late_rate_categories(shop, min_orders=1).collect()]
    assert rows == [("books", 200.0, 1), (None, 100.0, 1)]


def test_payments_count_once_per_item(shop):
    rows = {r.payment_type: r.n for r in sales.e03_payment_methods_in_category(shop, "books").collect()}
    assert rows == {"card": 2, "voucher": 2}
    shares = {(r.category, r.payment_type): (r.payment_value, r.payment_share_pct)
              for r in sales.h05_payment_share_top5_categories(shop).collect()}
    assert shares[("books", "card")] == (6.0, 54.55)
    assert all(category is not None for category, _ in shares)


def test_denominator_is_multi_item_orders(shop):
    assert sales.h07_multi_category_order_rate(shop).first()[0] == 0.0


def test_undelivered_order_has_no_delay(shop):
    assert service.m02_on_time_rate(shop).first()[0] == 0.0
    assert service.e06_late_orders_count(shop).first()[0] == 1
