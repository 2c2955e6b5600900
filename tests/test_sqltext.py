"""Text rules on single queries."""

import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import rubric, sqllex, sqltext
from tallyhouse.plans.querylog import read_tokens, verdicts


def judged(spark, *texts):
    log = spark.createDataFrame(list(enumerate(texts)), "query_id long, sql_text string")
    rows = verdicts(log).orderBy("query_id").collect()
    return [(r.failures, r.warnings) for r in rows]


CASES = [
    ("SELECT order_id FROM orders LIMIT 5", [], []),
    ("select order_id from orders", [], ["R8"]),
    ("SELECT state FROM (SELECT customer_state AS state FROM customers LIMIT 3) x", [], []),
    ("INSERT INTO orders VALUES (1)", ["R2", "R3"], ["R8"]),
    ("SELECT 'drop it' AS note FROM orders LIMIT 1", ["R3"], []),
    ("SELECT created_at FROM orders LIMIT 1", ["R10"], []),
    ("SELECT COUNT(*) FROM pg_catalog.sellers", [], []),
    ("SELECT tablename FROM pg_tables LIMIT 1", ["R4", "R5"], []),
    ("SELECT table_name FROM information_schema.tables LIMIT 1", ["R4", "R5"], []),
    ("WITH recent AS (SELECT order_id FROM orders) SELECT COUNT(*) FROM recent", ["R5"], []),
    ("SELECT geolocation_city FROM geolocation LIMIT 1", ["R6"], []),
    ("SELECT COUNT(*) FROM geolocation g JOIN geolocation_by_zip z ON g.geolocation_city = z.geolocation_city", [], []),
    ("SELECT COUNT( * ) FROM orders", [], []),
    ("SELECT o.* FROM orders o LIMIT 1", ["R7", "R10"], []),
    ("SELECT DISTINCT * FROM orders LIMIT 1", ["R7"], []),
    ("SELECT price * freight_value AS x FROM order_items LIMIT 1", [], []),
    ("SELECT p.product_name FROM products AS p LIMIT 1", ["R10"], []),
    ("SELECT order_status, COUNT(*) n FROM orders GROUP BY order_status ORDER BY n DESC", [], []),
    ("SELECT EXTRACT(DAY FROM order_approved_at - order_purchase_timestamp) AS d FROM orders LIMIT 1", [], []),
    ("SELECT COUNT(*) FROM products p JOIN product_category_translation t ON p.product_category_name = "
     "t.product_category_name", [], ["R9"]),
    ("SELECT COUNT(*) FROM products p LEFT JOIN product_category_translation t ON p.product_category_name = "
     "t.product_category_name", [], []),
    ("SELECT COUNT(*) FROM products p LEFT OUTER JOIN product_category_translation t ON p.product_category_name = "
     "t.product_category_name", [], []),
    # Quoted names, literals that look like comments and comments that look like literals.
    ('SELECT usename FROM "pg_shadow" LIMIT 1', ["R4", "R5"], []),
    ('SELECT x FROM "users" LIMIT 1', ["R5"], []),
    ('SELECT "order_id" FROM "orders" LIMIT 1', [], []),
    ('SELECT "odd name" FROM "odd table" LIMIT 1', ["R5"], []),
    ("SELECT order_id FROM orders WHERE order_status = '--' AND customer_id IN (SELECT id FROM secret_table) LIMIT 1", ["R5"], []),
    ("SELECT order_id FROM orders WHERE order_status = '/*' AND customer_id IN (SELECT id FROM secret_table WHERE a = '*/') LIMIT 1",
     ["R5"], []),
    ("SELECT order_id FROM orders -- it's fine\nWHERE order_status = 'from users' LIMIT 1", [], []),
    ("SELECT order_id FROM orders /* don't */ WHERE order_status = 'it''s from users' LIMIT 1", [], []),
    # Comma tables, at any depth.
    ("SELECT o.order_id FROM orders o, secret_table t LIMIT 1", ["R5"], []),
    ("SELECT o.order_id FROM (SELECT order_id FROM orders, secret_table) o, customers LIMIT 1", ["R5"], []),
    ("SELECT o.order_id, coalesce(o.order_status, 'x'), 1 FROM orders o, customers c WHERE o.customer_id = c.customer_id LIMIT 1", [], []),
    ("SELECT o.order_id FROM orders o JOIN customers c ON o.customer_id = c.customer_id, secret_table LIMIT 1", ["R5"], []),
    ("SELECT o.bad FROM customers c, orders o LIMIT 1", ["R10"], []),
    ("SELECT order_id FROM (orders) LIMIT 1", [], []),
    # Aliases without AS.
    ("SELECT order_id oid FROM orders ORDER BY oid LIMIT 2", [], []),
    ("SELECT p.product_id nm FROM products p ORDER BY nm LIMIT 2", [], []),
    ("SELECT order_id a, order_status b, 1 c, 'x' d FROM orders ORDER BY a, b, c, d LIMIT 2", [], []),
    ("SELECT CASE WHEN order_id = 'x' THEN 1 ELSE 2 END k FROM orders ORDER BY k LIMIT 2", [], []),
    ("SELECT DISTINCT nothing FROM orders LIMIT 2", ["R10"], []),
    # FROM that is no table list.
    ("SELECT order_id FROM orders WHERE order_status IS DISTINCT FROM customer_id LIMIT 5", [], []),
    ("SELECT order_id FROM orders WHERE order_status IS NOT DISTINCT FROM customer_id LIMIT 5", [], []),
    ("SELECT order_id, trim(both from order_status) FROM orders LIMIT 3", [], []),
    ("SELECT order_id, trim(leading 'x' from order_status) FROM orders LIMIT 3", [], []),
    ("SELECT order_id, substring(lower(order_status) from 2 for 3) FROM orders LIMIT 3", [], []),
    # Set operations.
    ("SELECT order_id FROM orders UNION SELECT order_id FROM order_items LIMIT 1", ["R2"], []),
    ("WITH a AS (SELECT 1) SELECT order_id FROM orders EXCEPT SELECT order_id FROM order_items LIMIT 1", ["R2"], []),
    ("SELECT COUNT(*) FROM (SELECT order_id FROM orders INTERSECT SELECT order_id FROM order_items) x", [], []),
    # Literals between dollar tags and with escapes, comments in comments, and what looks like them.
    ("SELECT o.order_id FROM orders o JOIN customers c ON o.customer_id = c.customer_id WHERE c.customer_city = $$it's$$ "
     "AND o.order_id IN (SELECT id FROM secret_table WHERE k = 'b') LIMIT 3", ["R5"], []),
    ("SELECT o.order_id FROM orders o JOIN customers c ON o.customer_id = c.customer_id WHERE c.customer_city = E'a\\'' "
     "AND o.order_id IN (SELECT id FROM secret_table WHERE k = 'b') LIMIT 3", ["R5"], []),
    ("SELECT o.order_id FROM orders o /* a /* nested */ , secret_table */ LIMIT 3", [], []),
    ("SELECT o.order_id FROM orders o /* a /* b /* c */ */ ' */ , secret_table LIMIT 3", ["R5"], []),
    ("SELECT o.order_id FROM orders o /*/ , secret_table */ LIMIT 3", [], []),
    ("SELECT o.order_id FROM orders o /**/, secret_table LIMIT 3", ["R5"], []),
    ("SELECT order_id FROM orders WHERE order_status = $a$ FROM secret_table $a$ LIMIT 3", [], []),
    ("SELECT order_id FROM orders WHERE order_status = $a$ $b$ $$ ' $a $a$ AND order_id IN (SELECT x FROM secret_table) LIMIT 3", ["R5"], []),
    ("SELECT order_id FROM orders WHERE order_status = $a$ x$b$a$ AND order_id IN (SELECT x FROM secret_table) LIMIT 3", ["R5"], []),
    ("SELECT order_id a$b$ FROM orders, secret_table c$b$ LIMIT 3", ["R5"], []),
    ("SELECT order_id FROM orders WHERE order_id = $1 AND order_status = $2 AND customer_id IN (SELECT x FROM secret_table) LIMIT 3",
     ["R5"], []),
    ("SELECT order_id FROM orders WHERE order_status = e'\\\\' AND order_id IN (SELECT x FROM secret_table) LIMIT 3", ["R5"], []),
    ("SELECT order_id FROM orders WHERE order_status = E'it''s \\' FROM secret_table ' LIMIT 3", [], []),
    ("SELECT order_id FROM orders WHERE order_status = 'a\\' AND order_id IN (SELECT x FROM secret_table) LIMIT 3", ["R5"], []),
    ("SELECT order_id FROM orders WHERE order_status = 'it''s -- fine' /* x */ LIMIT 3", [], []),
    ("SELECT order_id FROM orders WHERE order_status = '$$' AND order_id IN (SELECT x FROM secret_table WHERE y = '$$') LIMIT 3",
     ["R5"], []),
    ("SELECT price - -1 AS d FROM order_items -- 'x\nWHERE price > 1 LIMIT 3", [], []),
    ("SELECT order_id FROM orders WHERE order_status = 'open LIMIT 3", ["R1"], []),
    ("SELECT order_id FROM orders /* open /* */ LIMIT 3", ["R1"], []),
    ("SELECT order_id FROM orders WHERE order_status = $q$ open $$ LIMIT 3", ["R1"], []),
    # Words that are values, and word groups of operators and clauses.
    ("SELECT order_id FROM orders WHERE order_purchase_timestamp > CURRENT_TIMESTAMP LIMIT 3", [], []),
    ("SELECT order_id, CURRENT_DATE, localtimestamp d FROM orders LIMIT 3", [], []),
    ("SELECT order_approved_at AT TIME ZONE 'UTC' FROM orders LIMIT 3", [], []),
    ("SELECT order_id FROM orders WHERE order_status NOT SIMILAR TO 'a%' ESCAPE 'x' LIMIT 3", [], []),
    ("SELECT order_id FROM orders WHERE order_id = ANY(ARRAY['a', 'b']) LIMIT 3", [], []),
    ("SELECT order_id FROM orders ORDER BY order_id FETCH FIRST 5 ROWS ONLY", [], ["R8"]),
    ("SELECT order_id FROM orders OFFSET 2 ROWS FETCH NEXT ROW ONLY", [], ["R8"]),
    ("SELECT cast(price AS double precision), price::character varying FROM order_items LIMIT 1", [], []),
    ("SELECT order_purchase_timestamp + interval '1' day FROM orders LIMIT 1", [], []),
    ("SELECT sum(price) OVER (ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM order_items LIMIT 1", [], []),
    ("SELECT zone FROM orders LIMIT 1", ["R10"], []),
    # An alias means what the innermost scope says.
    ("SELECT COUNT(*) FROM (SELECT a.order_id FROM orders a) x JOIN (SELECT a.customer_state FROM customers a) y ON x.order_id = "
     "y.customer_state", [], []),
    ("SELECT COUNT(*) FROM (SELECT a.customer_state FROM orders a) x JOIN (SELECT a.customer_state FROM customers a) y ON true",
     ["R10"], []),
    ("SELECT o.order_id FROM orders o WHERE EXISTS (SELECT 1 FROM customers c WHERE c.customer_id = o.customer_id AND o.order_status = 'x') "
     "LIMIT 1", [], []),
    ("SELECT o.order_id FROM orders o WHERE EXISTS (SELECT 1 FROM customers o WHERE o.order_status = 'x') LIMIT 1", ["R10"], []),
    ("SELECT x.customer_state FROM orders o JOIN (SELECT customer_state FROM customers) AS x ON true LIMIT 1", [], []),
    ("SELECT COUNT(*) FROM (SELECT t.order_id FROM orders t UNION ALL SELECT t.customer_id FROM customers t) u", [], []),
    ("SELECT COUNT(*) FROM (SELECT t.order_id FROM orders t UNION ALL SELECT t.order_status FROM customers t) u", ["R10"], []),
    ("SELECT COUNT(*) FROM (orders o JOIN customers c ON o.customer_id = c.customer_id) WHERE o.customer_state = 'x'", ["R10"], []),
    ("-- only a comment", ["R1"], []),
    ("/* note */ SELECT COUNT(*) FROM orders -- * drop", ["R3"], []),
]


def test_rules(spark):
    got = judged(spark, *[c[0] for c in CASES])
    wrong = [(c[0], g, c[1:]) for c, g in zip(CASES, got) if g != (list(c[1]), list(c[2]))]
    assert not wrong


def test_unknown_columns_name_their_table(spark):
    log = spark.createDataFrame(
        [(1, "SELECT p.nothing, q.product_id FROM products p JOIN order_items q ON q.bad = p.product_id LIMIT 2")],
        "query_id long, sql_text string",
    )
    assert read_tokens(log).select("unknown").first()[0] == ["order_items.bad", "products.nothing"]


# Pieces of SQL, and the same without comments and with standard literals.
PIECES = {
    "a ": "a ", "e": "e", " FROM t": " FROM t", "- ": "- ", "/ ": "/ ", "* ": "* ", "$1 ": "$1 ", "x$y ": "x$y ", "\n": "\n",
    "'it''s' ": "'it''s' ", "'/* -- $$ \"' ": "'/* -- $$ \"' ", '"o""d\'d" ': '"o""d\'d" ', " E'\\'--\\\\' ": " '''--\\' ",
    " e'/*''' ": " '/*''' ", " $$'$ \"$$ ": " '''$ \"' ", " $q_1$ $$ -- $q$ '$q_1$ ": " ' $$ -- $q$ ''' ",
    "/* ' /* $$ */ \" */": " ", "/**/": " ", "/***/": " ", "-- ' \" $$ /*\n": " \n", "(": "(", "ü ": "ü ",
}


def test_lexer_on_random_texts(spark):
    rng = random.Random(11)
    drawn = [rng.choices(list(PIECES), k=rng.randint(0, 12)) for _ in range(400)]
    texts = [(" ".join(d), " ".join(PIECES[p] for p in d)) for d in drawn]
    frame = spark.createDataFrame(texts, "t string, want string")
    wrong = frame.select("*", sqllex.standard_code("t").alias("got")).where("got <> want").collect()
    assert not wrong, wrong[0]


def test_texts_of_one_shape_are_read_once(spark):
    log = spark.createDataFrame(
        [(i, f"SELECT order_id FROM orders WHERE order_status = 'x{i}' AND customer_id = $t${i}'$t$ LIMIT {i}") for i in range(50)],
        "query_id long, sql_text string",
    )
    shapes = log.withColumn("code", sqltext.code("sql_text")).select(sqltext.shape(sqltext.bare(F.col("code"))).alias("shape"))
    assert shapes.distinct().count() == 1
    assert {tuple(r.failures) for r in verdicts(log).collect()} == {()}


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('SELECT "a" ,b FROM  t WHERE x=1 ;', "select a, b from t where x = 1"),
        ("\n Count( * )  ", "count(*)"),
        ("a;;", "a"),
    ],
)
def test_normalized(spark, text, expected):
    assert value(spark, sqltext.normalized, text) == expected


@pytest.mark.parametrize(
    "text, verdict, passed",
    [
        ("  ", "empty", None),
        ("WITH x AS (SELECT 1) SELECT 1", "not select", None),
        ("select created_at from t", "forbidden CREATE", None),
        ("select a from t;", "ok", "select a from t LIMIT 10000"),
        ("select shipping_limit_date from t", "ok", "select shipping_limit_date from t"),
    ],
)
def test_gate_keeps_its_substring_quirks(spark, text, verdict, passed):
    assert value(spark, sqltext.gate_verdict, text) == verdict
    if passed:
        assert value(spark, sqltext.gate_text, text) == passed


@pytest.mark.parametrize(
    "text, where, limit",
    [
        ("SELECT a FROM (SELECT a FROM t WHERE x = 1 LIMIT 5) q WHERE y = (2) LIMIT 100", "y = (2)", "100"),
        ("SELECT a FROM (SELECT a FROM t WHERE x = 1 LIMIT 5) q", "x = 1", "5"),
        ("WITH q AS (SELECT a FROM t WHERE x = 1) SELECT a FROM q WHERE b = 'limit 3' GROUP BY a", "b = 'limit 3'", None),
        ("SELECT a FROM t", None, None),
        ("SELECT a FROM t WHERE b IN (SELECT c FROM d WHERE e = 1 ORDER BY c LIMIT 2) AND f = 2;",
         "b IN (SELECT c FROM d WHERE e = 1 ORDER BY c LIMIT 2) AND f = 2", "2"),
    ],
)
def test_outermost_clauses(spark, text, where, limit):
    found = value(spark, lambda c: sqltext.shallowest_clause(c, "where", sqltext.CLAUSE_ENDS), text)
    assert (found and found.strip()) == where
    found = value(spark, lambda c: sqltext.shallowest_clause(c, "limit", ["offset", "fetch"]), text)
    assert (found and found.strip()) == limit


def test_grades_look_at_the_outermost_limit_and_where(spark):
    text = "SELECT order_id FROM (SELECT order_id FROM orders WHERE a = 1 LIMIT 5) x WHERE b = 2 LIMIT 100"

    def graded(column):
        return spark.range(1).select(column).first()[0]

    sql = F.lit(text)
    where = sqltext.shallowest_clause(sql, "where", sqltext.CLAUSE_ENDS)
    limit = sqltext.shallowest_clause(F.lower(sql), "limit", [])
    assert graded(rubric.grade_aggregation(F.array(F.lit("LIMIT 100")), F.lower(sql), limit)) == "correct"
    assert graded(rubric.grade_aggregation(F.array(F.lit("LIMIT 5")), F.lower(sql), limit)) == "wrong"
    assert graded(rubric.grade_filters(F.array(F.lit("b = 2"), F.lit("a = 1")), where, sql)) == "flag"


def test_fences(spark):
    assert value(spark, sqltext.sql_in_fence, "Look:\n```SQL\nSELECT 1\n```\nmore\n```\nno\n```") == "SELECT 1"
    assert value(spark, sqltext.sql_in_fence, "  SELECT 2\n") == "SELECT 2"
    assert value(spark, sqltext.fences_removed, "```sql\nSELECT 3\n```") == "SELECT 3"
