"""Policy audit and rubric grading of a log of SQL texts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import rubric, sqltext
from tallyhouse.functions.grading import any_grade
from tallyhouse.functions.text import rubric_block, stripped
from tallyhouse.plans.star import Star

# Logged texts, by remainder of the query number; one gets a varying limit.
LOGGED = [
    "SELECT order_id FROM orders",
    "select * from customers",
    "SELECT COUNT(*) AS n FROM order_items i JOIN products p ON i.product_id = p.product_id",
    "DROP TABLE customers",
    "SELECT x FROM pg_tables",
    "SELECT zip FROM geolocation g",
    "SELECT p.product_name FROM products p LIMIT 5",
    "SELECT t.product_category_name_english FROM products p JOIN product_category_translation t "
    "ON p.product_category_name = t.product_category_name",
    "SELECT a FROM unknown_table; DELETE FROM orders",
    "SELECT table_name FROM information_schema.tables",
    "SELECT order_id FROM order_items WHERE shipping_limit_date IS NOT NULL",
    "SELECT c.customer_state, AVG(EXTRACT(DAY FROM o.order_delivered_customer_date - o.order_purchase_timestamp)) "
    "AS days FROM orders o JOIN customers c ON o.customer_id = c.customer_id WHERE o.order_status = 'delivered' "
    "AND o.order_delivered_customer_date >= '2018-01-01' AND o.customer_id <> 'x' "
    "GROUP BY c.customer_state ORDER BY days DESC LIMIT 50",
    "-- daily check\nWITH recent AS (SELECT order_id, created_at FROM orders) SELECT order_id FROM recent",
    "SELECT s.seller_id, g.* FROM sellers s LEFT JOIN geolocation_by_zip g ON s.seller_zip_code_prefix = "
    "g.geolocation_zip_code_prefix JOIN geolocation r ON r.geolocation_city = g.geolocation_city",
    "   ",
    "SELECT  o.order_status , COUNT( * ) AS n FROM orders o LEFT JOIN customers c "
    "ON o.customer_id=c.customer_id GROUP BY o.order_status LIMIT ",
    'SELECT usename FROM "pg_shadow"',
    "SELECT customer_id FROM customers WHERE customer_city = '--' AND customer_id IN (SELECT id FROM secret_table) LIMIT 3",
    "SELECT o.order_id FROM orders o, secret_table t",
    "SELECT order_id oid FROM orders ORDER BY oid LIMIT 2",
    "SELECT order_id, trim(both from order_status) FROM orders WHERE order_status IS DISTINCT FROM customer_id LIMIT 3",
    "SELECT order_id FROM orders UNION SELECT order_id FROM order_items LIMIT 9",
    "SELECT order_id FROM (SELECT order_id FROM orders WHERE order_status = 'shipped' LIMIT 5) x "
    "WHERE order_id <> 'y' LIMIT 100",
    "SELECT o.order_id FROM orders o JOIN customers c ON o.customer_id = c.customer_id WHERE c.customer_city = $$it's$$ "
    "AND o.order_id IN (SELECT id FROM secret_table WHERE k = 'b') LIMIT 3",
    "SELECT o.order_id FROM orders o JOIN customers c ON o.customer_id = c.customer_id WHERE c.customer_city = E'a\\'' "
    "AND o.order_id IN (SELECT id FROM secret_table WHERE k = 'b') LIMIT 3",
    "SELECT o.order_id FROM orders o /* a /* nested */ , secret_table */ LIMIT 3",
    "SELECT order_id FROM orders WHERE order_status = $a$ FROM secret_table $a$ LIMIT 3",
    "SELECT order_id FROM orders WHERE order_purchase_timestamp >= CURRENT_TIMESTAMP AND order_approved_at AT TIME ZONE 'UTC' "
    "< CURRENT_DATE AND order_status SIMILAR TO 'a%' AND order_id = ANY(ARRAY['x']) FETCH FIRST 5 ROWS ONLY",
    "SELECT COUNT(*) AS n FROM (SELECT a.order_id FROM orders a) x JOIN (SELECT a.customer_state FROM customers a) y "
    "ON x.order_id = y.customer_state",
]
WITH_LIMIT = 15

# Texts made from the turns of conversations: {text} is a turn's whole text, written as the place it
# stands in asks for, {key} a conversation's number. The first of them has this number.
FROM_TURNS = 100
TURN_TEXTS = [
    "SELECT o.order_id FROM orders o WHERE o.order_status = '{quoted}' LIMIT 3",
    "SELECT o.order_id FROM orders o JOIN customers c ON o.customer_id = c.customer_id WHERE c.customer_city = "
    "$t{key}$it's {text}$t{key}$ AND o.order_id IN (SELECT id FROM secret_table WHERE k = 'b') LIMIT 3",
    "SELECT o.order_id FROM orders o WHERE o.order_status = E'it\\'s {escaped}' AND o.order_id IN "
    "(SELECT id FROM secret_table WHERE k = 'b') LIMIT 3",
    "SELECT o.order_id FROM orders o /* {comment} /* nested */ , secret_table */ LIMIT 3",
    "SELECT order_id FROM orders WHERE order_status = $a$ FROM secret_table {text} $a$ AND order_purchase_timestamp >= "
    "CURRENT_TIMESTAMP LIMIT 4",
    "SELECT COUNT(*) AS n FROM (SELECT a.order_id FROM orders a WHERE a.order_status = '{quoted}') x JOIN "
    "(SELECT a.customer_id, a.customer_state FROM customers a WHERE a.customer_city <> '{quoted}') y ON x.order_id = y.customer_id",
    "SELECT r{key}.nothing FROM orders r{key} WHERE r{key}.order_id > '{quoted}' LIMIT 5",
    "SELECT order_id FROM orders WHERE order_status SIMILAR TO '{quoted}' AND (order_purchase_timestamp AT TIME ZONE 'UTC')::date "
    "< CURRENT_DATE FETCH FIRST 7 ROWS ONLY",
]
# Numbers of these queries begin here, above those of the events.
TURN_QUERIES = 10**12

# Rubric cells per dimension, by remainder of the query number modulo five.
CELLS = {
    "table": [
        "", "orders.order_id", "orders.order_id; customers.customer_state",
        "order_items, products.product_id", '"order_status", nothing.here',
    ],
    "filters": [
        "order_status = 'delivered'", "", "shipping_limit_date IS NOT NULL; price > 5",
        "o.order_status  = 'delivered', x.customer_id <> 'x'", "from orders",
    ],
    "aggregation": [
        "COUNT, GROUP BY order_status", "AVG; ORDER BY days; LIMIT 5", "", "SUM(CASE x), DISTINCT id", "LIMIT 100, any text",
    ],
    "join": [
        "orders o LEFT JOIN customers c", "orders JOIN customers ON id; order_items INNER JOIN products",
        "sellers RIGHT JOIN geolocation_by_zip", "", "nothing known",
    ],
    "date_operator": [
        "date operator: >= (from)", "a < b; c >= d", "none named", "a <= b", "",
    ],
    "time_frame": [
        "", "DATE_PART('day', a - b)", "to_char(ts), date_part('year', ts)", "no function", "avg(days), count(x)",
    ],
}


def _pick(key: Column, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def _filled(template: str, values: dict[str, Column]) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[part] if i % 2 else F.lit(part) for i, part in enumerate(parts)])


def turn_log(star: Star) -> DataFrame:
    """A query per turn of a conversation, with its whole text as a literal or comment."""
    key, turn, text = F.col("conv_id"), F.col("turn"), F.coalesce("text", F.lit(""))
    values = {
        "key": key.cast("string"),
        "text": text,
        "quoted": F.replace(text, F.lit("'"), F.lit("''")),
        "escaped": F.regexp_replace(text, r"([\\'])", r"\\$1"),
        "comment": F.regexp_replace(text, r"[*/]", " "),
    }
    number = (key + turn) % len(TURN_TEXTS)
    texts = F.when(F.lit(False), "")
    for i, template in enumerate(TURN_TEXTS):
        texts = texts.when(number == i, _filled(template, values))
    return star.base("conversations").select(
        (F.lit(TURN_QUERIES) + key * 100_000 + turn).alias("query_id"), texts.alias("sql_text")
    )


def query_log(star: Star) -> DataFrame:
    """Written texts for every event, and one made from every turn of a conversation."""
    key = F.col("event_id")
    base = _pick(key, LOGGED)
    limited = key % len(LOGGED) == WITH_LIMIT
    tail = F.concat((key % 90).cast("string"), F.lit(";"))
    written = star.base("events").select(
        key.alias("query_id"), F.when(limited, F.concat(base, tail)).otherwise(base).alias("sql_text")
    )
    return written.unionByName(turn_log(star))


def read_tokens(log: DataFrame) -> DataFrame:
    """A log with its bare text and what the tokens of its text tell.

    Tokens are read once per shape: texts that differ in literals and numbers alone share them.
    What depends on literals (forbidden words, the outermost WHERE and LIMIT) is read per text.
    """
    names, form = F.col("names"), F.col("shape")
    texts = (
        log.withColumn("code", sqltext.code("sql_text"))
        .withColumn("text", sqltext.bare(F.col("code")))
        .withColumn("shape", sqltext.shape(F.col("text")))
    )
    shapes = texts.groupBy(F.md5("shape").alias("shape_key")).agg(F.first("shape").alias("shape"))
    tokens = (
        shapes.withColumn("names", sqltext.names_in_scope("shape"))
        .withColumns(
            {
                "tables": sqltext.table_names(names["refs"]),
                "ignored": sqltext.select_aliases(form),
                "plain": sqltext.plain_columns(form),
                "joins": sqltext.join_clauses(form),
                "has_aggregation": sqltext.has_aggregation(form),
            }
        )
        .select(
            "shape_key", "tables", "plain", "joins", "has_aggregation",
            sqltext.prefixed_columns(form).alias("qualified"),
            sqltext.statement_kind(form).alias("kind"),
            sqltext.selects_star(form).alias("selects_star"),
            sqltext.unfinished(form).alias("unfinished"),
            sqltext.inner_joins_lookup(F.col("joins")).alias("inner_lookup"),
            sqltext.unknown_columns(F.col("tables"), names, F.col("ignored"), F.col("plain")).alias("unknown"),
        )
    )
    return (
        texts.withColumn("shape_key", F.md5("shape")).join(tokens, "shape_key").drop("shape_key", "shape")
        .withColumn("has_limit", sqltext.has_limit(F.col("sql_text"), F.col("text")))
        .withColumn("unlimited", ~F.col("has_aggregation") & ~F.col("has_limit"))
    )


def distinct_texts(log: DataFrame) -> DataFrame:
    """Each text once with its digest and the number of its queries."""
    return log.groupBy(F.md5("sql_text").alias("digest")).agg(
        F.first("sql_text").alias("sql_text"), F.count("*").alias("n_queries")
    )


def once_per_text(star: Star, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Judges each distinct text once and hands the result to its queries.

    ``judge`` gets (digest, sql_text) rows, keeps the digest and may drop rows. Logs repeat
    themselves, so the costly text rules run on few rows; where all texts differ they run on each.
    """
    log = query_log(star)
    judged = judge(distinct_texts(log).select("digest", "sql_text"))
    return log.select("query_id", F.md5("sql_text").alias("digest")).join(judged, "digest").drop("digest")


def listed(items: Column) -> Column:
    return F.array_join(items, ",")


def each(rows: DataFrame, items: Column, name: str) -> DataFrame:
    """One row per item; unlike a plain explode it evaluates ``items`` once, not in a filter as well."""
    return rows.select("digest", F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


# -- single rules -----------------------------------------------------------------------


def log_statement_kind(star: Star) -> DataFrame:
    judged = once_per_text(star, lambda texts: read_tokens(texts).select("digest", "kind"))
    return judged.withColumn("allowed", F.col("kind").isin("SELECT", "WITH").cast("int"))


def log_forbidden_keyword(star: Star) -> DataFrame:
    return once_per_text(star, lambda texts: each(texts, sqltext.forbidden_words(F.col("sql_text")), "word"))


def _where(star: Star, test: Column) -> DataFrame:
    return once_per_text(star, lambda texts: read_tokens(texts).where(test).select("digest"))


def log_system_catalog(star: Star) -> DataFrame:
    return _where(star, sqltext.reads_catalog(F.col("sql_text"), F.col("tables")))


def log_allow_list(star: Star) -> DataFrame:
    return once_per_text(
        star, lambda texts: each(read_tokens(texts), sqltext.tables_not_allowed(F.col("tables")), "table_name")
    )


def log_trap_table(star: Star) -> DataFrame:
    return _where(star, sqltext.uses_trap_table(F.col("tables")))


def log_select_star(star: Star) -> DataFrame:
    return _where(star, F.col("selects_star"))


def log_limit_rule(star: Star) -> DataFrame:
    def judge(texts: DataFrame) -> DataFrame:
        return read_tokens(texts).select(
            "digest",
            F.col("has_aggregation").cast("int").alias("has_aggregation"),
            F.col("has_limit").cast("int").alias("has_limit"),
            sqltext.with_default_limit(F.col("sql_text"), F.col("unlimited")).alias("sql_text"),
        )

    return once_per_text(star, judge)


def log_table_usage(star: Star) -> DataFrame:
    """Queries per referenced table."""
    names = sqltext.mentioned_tables(F.col("sql_text"))
    used = distinct_texts(query_log(star)).select("n_queries", F.explode_outer(names).alias("table_name"))
    return (
        used.where(F.col("table_name").isNotNull()).groupBy("table_name").agg(F.sum("n_queries").alias("n_queries"))
    )


def log_soft_fk_warning(star: Star) -> DataFrame:
    return _where(star, F.col("inner_lookup"))


def log_unknown_columns(star: Star) -> DataFrame:
    return once_per_text(star, lambda texts: each(read_tokens(texts), F.col("unknown"), "column_name"))


def verdicts(log: DataFrame) -> DataFrame:
    sql, code, unfinished = F.col("sql_text"), F.col("code"), F.col("unfinished")
    return read_tokens(log).select(
        *log.columns,
        sqltext.rule_failures(
            sql, code, unfinished, F.col("kind"), F.col("selects_star"), F.col("tables"), F.col("unknown")
        ).alias("failures"),
        sqltext.rule_warnings(code, unfinished, F.col("unlimited"), F.col("inner_lookup")).alias("warnings"),
    )


def log_policy_verdict(star: Star) -> DataFrame:
    def judge(texts: DataFrame) -> DataFrame:
        return verdicts(texts).select(
            "digest",
            (F.size("failures") == 0).cast("int").alias("valid"),
            listed(F.col("failures")).alias("rule_failures"),
            listed(F.col("warnings")).alias("warnings"),
        )

    return once_per_text(star, judge)


def log_rule_rollup(star: Star) -> DataFrame:
    """Queries that break each rule."""
    broken = verdicts(distinct_texts(query_log(star))).select("n_queries", F.explode_outer("failures").alias("rule"))
    return broken.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.sum("n_queries").alias("n"))


def log_api_gate(star: Star) -> DataFrame:
    verdict = sqltext.gate_verdict(F.col("sql_text"))
    return query_log(star).select(
        "query_id",
        verdict.alias("verdict"),
        F.when(verdict == "ok", sqltext.gate_text(F.col("sql_text"))).alias("sql_text"),
    )


def log_extract_fenced_sql(star: Star) -> DataFrame:
    """Answers of a model: a fenced block with prose around it for even numbers, plain text otherwise."""
    sql = F.col("sql_text")
    fenced = F.concat(F.lit("Here it is:\n```sql\n"), sql, F.lit("\n```\nDone."))
    answers = query_log(star).withColumn("answer", F.when(F.col("query_id") % 2 == 0, fenced).otherwise(sql))
    return answers.select(
        "query_id",
        sqltext.sql_in_fence(F.col("answer")).alias("extracted"),
        sqltext.fences_removed(F.col("answer")).alias("unfenced"),
    )


# -- exact match ------------------------------------------------------------------------


def em_normalize_sql(star: Star) -> DataFrame:
    return query_log(star).select("query_id", sqltext.normalized(F.col("sql_text")).alias("normalized"))


def em_exact_match(star: Star) -> DataFrame:
    """Raw and normalised equality; predictions are respelled, quoted, or altered."""
    gold, key = F.col("sql_text"), F.col("query_id")
    capitals = F.translate(gold, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    predicted = (
        F.when(key % 5 == 0, gold)
        .when(key % 5 == 1, F.concat(F.lit("\n "), capitals, F.lit(" ;")))
        .when(key % 5 == 2, F.replace(gold, F.lit("order_id"), F.lit('"order_id"')))
        .when(key % 5 == 3, F.concat(F.lit(" "), gold, F.lit("  ")))
        .otherwise(F.concat(gold, F.lit(" x")))
    )
    pairs = query_log(star).withColumn("predicted", predicted)
    same_raw = stripped(gold) == stripped(F.col("predicted"))
    same = sqltext.normalized(gold) == sqltext.normalized(F.col("predicted"))
    return pairs.select("query_id", same.cast("int").alias("em"), same_raw.cast("int").alias("em_raw"))


# -- rubric -----------------------------------------------------------------------------


def rubric_cells() -> dict[str, Column]:
    return {f"text_{d}": _pick(F.col("query_id"), values) for d, values in CELLS.items()}


def graded(star: Star, dimensions: list[str]) -> DataFrame:
    """Grades of each distinct pair of text and cells, handed to their queries."""
    cells = [f"text_{d}" for d in dimensions]
    log = query_log(star).withColumns({c: rubric_cells()[c] for c in cells}).withColumn(
        "pair", F.md5(F.to_json(F.struct("sql_text", *cells)))
    )
    pairs = log.groupBy("pair").agg(*[F.first(c).alias(c) for c in ("sql_text", *cells)])
    # Each text's tokens are read once, however many cells it meets.
    texts = read_tokens(distinct_texts(log).select("digest", "sql_text")).select(
        "digest", "code", "text", "tables", "qualified", "plain", "joins",
        sqltext.shallowest_clause(F.col("code"), "where", sqltext.CLAUSE_ENDS).alias("outer_where"),
        sqltext.shallowest_clause(F.col("text"), "limit", ["offset", "fetch"]).alias("outer_limit"),
    )
    judged = (
        pairs.withColumn("digest", F.md5("sql_text")).join(texts, "digest")
        .withColumns({f"cell_{d}": rubric_block(F.col(f"text_{d}")) for d in dimensions})
        .select("pair", *[grade(d).alias(d) for d in dimensions])
    )
    return log.select("query_id", "pair").join(judged, "pair").drop("pair")


def grade(dimension: str) -> Column:
    items, sql, text, tables = F.col(f"cell_{dimension}.items"), F.col("sql_text"), F.col("text"), F.col("tables")
    return {
        "table": lambda: rubric.grade_table(items, tables, F.col("qualified"), F.col("plain")),
        "filters": lambda: rubric.grade_filters(items, F.col("outer_where"), F.col("code")),
        "aggregation": lambda: rubric.grade_aggregation(items, text, F.col("outer_limit")),
        "join": lambda: rubric.grade_join(items, tables, F.col("joins")),
        "date_operator": lambda: rubric.grade_date_operator(items, text),
        "time_frame": lambda: rubric.grade_time_frame(F.col("cell_time_frame.spec"), sql),
    }[dimension]()


def graded_dimension(star: Star, dimension: str) -> DataFrame:
    return graded(star, [dimension]).withColumnRenamed(dimension, "grade")


def rubric_table(star: Star) -> DataFrame:
    return graded_dimension(star, "table")


def rubric_filters(star: Star) -> DataFrame:
    return graded_dimension(star, "filters")


def rubric_aggregation(star: Star) -> DataFrame:
    return graded_dimension(star, "aggregation")


def rubric_join(star: Star) -> DataFrame:
    return graded_dimension(star, "join")


def rubric_date_operator(star: Star) -> DataFrame:
    return graded_dimension(star, "date_operator")


def rubric_time_frame(star: Star) -> DataFrame:
    return graded_dimension(star, "time_frame")


def rubric_verdict(star: Star) -> DataFrame:
    """Whether any dimension is wrong, and whether any is flagged."""
    grades = [F.col(d) for d in rubric.DIMENSIONS]
    return graded(star, rubric.DIMENSIONS).select(
        "query_id",
        any_grade(grades, "wrong").cast("int").alias("any_wrong"),
        any_grade(grades, "flag").cast("int").alias("any_flag"),
    )
