"""Oracle bodies for the query-log audit.

What a parser would find in the logged texts is stated by hand per text number
(``tpl``); rules on plain text are SQL patterns.
"""

import re

from tallyhouse.plans.querylog import CELLS, FROM_TURNS, LOGGED, TURN_QUERIES, TURN_TEXTS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(texts: list[str]) -> str:
    return ", ".join(f"({i}, {_quoted(t)})" for i, t in enumerate(texts))


def _cell(dimension: str) -> str:
    return f"""
        select l.query_id, l.tpl, l.sql_text, l.said, l.conv_id, c.i cell, c.txt,
               [trim(x) for x in string_split(c.txt, case when contains(c.txt, ';') then ';' else ',' end)
                if trim(x) <> ''] items
        from x_query_log l join (values {_values(CELLS[dimension])}) c(i, txt) on c.i = l.query_id % 5"""


_NORMAL = r"""rtrim(trim(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      replace(replace(trim(lower({0}), chr(10) || ' '), '`', ''), '"', ''),
      '\s+', ' ', 'g'), '\s*,\s*', ', ', 'g'), '\s*\(\s*', '(', 'g'), '\s*\)\s*', ')', 'g'), '\s*=\s*', ' = ', 'g')),
    ';')"""


def _normal(column: str) -> str:
    return f"trim({_NORMAL.format(column)})"


def _grade(missing: str, total: str) -> str:
    return f"""case when {total} = 0 then 'NA' when {missing} = 0 then 'correct'
                    when {missing} < {total} then 'flag' else 'wrong' end"""


_TURN_VALUES = {
    "key": "cast(conv_id as varchar)",
    "text": "said",
    "quoted": "replace(said, '''', '''''')",
    "escaped": r"regexp_replace(said, '([\\''])', '\\\1', 'g')",
    "comment": "regexp_replace(said, '[*/]', ' ', 'g')",
}


def _turn_text(template: str) -> str:
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(_TURN_VALUES[p] if i % 2 else _quoted(p) for i, p in enumerate(parts))


def _turn_texts() -> str:
    cases = " ".join(f"when {i} then {_turn_text(t)}" for i, t in enumerate(TURN_TEXTS))
    return f"case (conv_id + turn) % {len(TURN_TEXTS)} {cases} end"


_FORBIDDEN = r"'\b(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|GRANT|REVOKE|COPY|VACUUM|REINDEX)\b'"
_GATE = "INSERT UPDATE DELETE DROP CREATE ALTER TRUNCATE GRANT REVOKE".split()

VIEWS = {
    "x_query_log": f"""
        select e.event_id query_id, cast(t.i as int) tpl,
               case when t.i = 15 then t.txt || (e.event_id % 90) || ';' else t.txt end sql_text, '' said, 0 conv_id
        from events e join (values {_values(LOGGED)}) t(i, txt) on t.i = e.event_id % {len(LOGGED)}
        union all
        select {TURN_QUERIES} + conv_id * 100000 + turn, cast({FROM_TURNS} + (conv_id + turn) % {len(TURN_TEXTS)} as int), {_turn_texts()}, said, conv_id
        from (select conv_id, turn, coalesce(text, '') said from conversations)""",
    # tables and columns each text refers to
    "x_names": """
        select * from (values
          (0, ['orders'], ['order_id']), (1, ['customers'], []), (2, ['order_items', 'products'], ['product_id']),
          (3, ['customers'], []), (4, ['pg_tables'], ['x']), (5, ['geolocation'], ['zip']),
          (6, ['products'], ['product_name']),
          (7, ['products', 'product_category_translation'], ['product_category_name', 'product_category_name_english']),
          (8, ['unknown_table', 'orders'], ['a']), (9, ['tables'], ['table_name']),
          (10, ['order_items'], ['order_id', 'shipping_limit_date']),
          (11, ['orders', 'customers'], ['customer_state', 'order_delivered_customer_date', 'customer_id',
                'order_purchase_timestamp', 'order_status', 'days']),
          (12, ['orders', 'recent'], ['order_id', 'created_at']),
          (13, ['sellers', 'geolocation_by_zip', 'geolocation'], ['seller_id', 'seller_zip_code_prefix',
                'geolocation_zip_code_prefix', 'geolocation_city']),
          (14, [], []), (15, ['orders', 'customers'], ['order_status', 'customer_id']),
          (16, ['pg_shadow'], ['usename']), (17, ['customers', 'secret_table'], ['customer_id', 'customer_city', 'id']),
          (18, ['orders', 'secret_table'], ['order_id']), (19, ['orders'], ['order_id', 'oid']),
          (20, ['orders'], ['order_id', 'order_status', 'customer_id']), (21, ['orders', 'order_items'], ['order_id']),
          (22, ['orders'], ['order_id', 'order_status']),
          (23, ['orders', 'customers', 'secret_table'], ['order_id', 'customer_id', 'customer_city', 'id', 'k']),
          (24, ['orders', 'customers', 'secret_table'], ['order_id', 'customer_id', 'customer_city', 'id', 'k']),
          (25, ['orders'], ['order_id']), (26, ['orders'], ['order_id', 'order_status']),
          (27, ['orders'], ['order_id', 'order_purchase_timestamp', 'order_approved_at', 'order_status']),
          (28, ['orders', 'customers'], ['order_id', 'customer_state']),
          (100, ['orders'], ['order_id', 'order_status']),
          (101, ['orders', 'customers', 'secret_table'], ['order_id', 'customer_id', 'customer_city', 'id', 'k']),
          (102, ['orders', 'secret_table'], ['order_id', 'order_status', 'id', 'k']), (103, ['orders'], ['order_id']),
          (104, ['orders'], ['order_id', 'order_status', 'order_purchase_timestamp']),
          (105, ['orders', 'customers'], ['order_id', 'order_status', 'customer_id', 'customer_state', 'customer_city']),
          (106, ['orders'], ['nothing', 'order_id']),
          (107, ['orders'], ['order_id', 'order_status', 'order_purchase_timestamp'])) v(tpl, tabs, cols)""",
    "x_broken": """
        select * from (values
          (0, '', 'R8'), (1, 'R7', 'R8'), (2, '', ''), (3, 'R2,R3', 'R8'), (4, 'R4,R5', 'R8'), (5, 'R6,R10', 'R8'),
          (6, 'R10', ''), (7, '', 'R8,R9'), (8, 'R3,R5', 'R8'), (9, 'R4,R5', 'R8'), (10, '', 'R8'), (11, '', ''),
          (12, 'R5', 'R8'), (13, 'R7,R10', 'R8'), (14, 'R1', ''), (15, '', ''), (16, 'R4,R5', 'R8'), (17, 'R5', ''),
          (18, 'R5', 'R8'), (19, '', ''), (20, '', ''), (21, 'R2', ''), (22, '', ''), (23, 'R5', ''), (24, 'R5', ''),
          (25, '', ''), (26, '', ''), (27, '', 'R8'), (28, '', ''), (100, '', ''), (101, 'R5', ''), (102, 'R5', ''),
          (103, '', ''), (104, '', ''), (105, '', ''), (106, 'R10', ''), (107, '', 'R8')) v(tpl, failures, warnings)""",
    # what a turn's text adds: it may hold a forbidden word, or read like a limit
    "x_judged": f"""
        select l.query_id, l.tpl, l.sql_text,
               array_to_string([x for x in [case when l.tpl >= {FROM_TURNS} and regexp_matches(upper(l.sql_text), {_FORBIDDEN}) then 'R3' end,
                                            b.failures] if x <> ''], ',') failures,
               case when l.tpl >= {FROM_TURNS} and regexp_matches(l.sql_text, '(?i)\\blimit\\s+\\d+') then '' else b.warnings end warnings
        from x_query_log l join x_broken b on b.tpl = l.tpl""",
    "x_cell_table": _cell("table"),
    "x_cell_filters": _cell("filters"),
    "x_cell_aggregation": _cell("aggregation"),
    "x_cell_join": _cell("join"),
    "x_cell_date_operator": _cell("date_operator"),
    "x_cell_time_frame": _cell("time_frame"),
    "x_grade_table": f"""
        , checked as (
          select c.query_id, len(c.items) total,
                 len([x for x in c.items if not list_contains(list_concat(n.tabs, n.cols),
                        list_last(string_split(lower(replace(x, '"', '')), '.')))]) missing
          from x_cell_table c join x_names n on n.tpl = c.tpl)
        select query_id, {_grade('missing', 'total')} grade from checked""",
    "x_grade_filters": f"""
        , spelled as (select *, regexp_replace('''' || replace(said, '''', '''''') || '''', '\\s+', ' ', 'g') lit from x_cell_filters),
        scoped as (
          select *, lower(case tpl when 10 then 'shipping_limit_date IS NOT NULL'
                    when 11 then 'o.order_status = ''delivered'' AND o.order_delivered_customer_date >= ''2018-01-01'' AND o.customer_id <> ''x'''
                    when 17 then 'customer_city = ''--'' AND customer_id IN (SELECT id FROM secret_table)'
                    when 20 then 'order_status IS DISTINCT FROM customer_id' when 22 then 'order_id <> ''y'''
                    when 23 then 'c.customer_city = ''it''''s'' AND o.order_id IN (SELECT id FROM secret_table WHERE k = ''b'')'
                    when 24 then 'c.customer_city = ''a'''''' AND o.order_id IN (SELECT id FROM secret_table WHERE k = ''b'')'
                    when 25 then 'SELECT o.order_id FROM orders o LIMIT 3' when 26 then 'order_status = '' FROM secret_table '''
                    when 27 then 'order_purchase_timestamp >= CURRENT_TIMESTAMP AND order_approved_at AT TIME ZONE ''UTC'' < CURRENT_DATE '
                              || 'AND order_status SIMILAR TO ''a%'' AND order_id = ANY(ARRAY[''x''])'
                    when 100 then 'o.order_status = ' || lit
                    when 101 then 'c.customer_city = ''it''''s ' || lit[2 :] || ' AND o.order_id IN (SELECT id FROM secret_table WHERE k = ''b'')'
                    when 102 then 'o.order_status = ''it''''s ' || lit[2 :] || ' AND o.order_id IN (SELECT id FROM secret_table WHERE k = ''b'')'
                    when 103 then 'SELECT o.order_id FROM orders o LIMIT 3'
                    when 104 then 'order_status = '' FROM secret_table ' || lit[2 : -2] || ' '' AND order_purchase_timestamp >= CURRENT_TIMESTAMP'
                    when 105 then 'a.order_status = ' || lit when 106 then 'r' || conv_id || '.order_id > ' || lit
                    when 107 then 'order_status SIMILAR TO ' || lit || ' AND (order_purchase_timestamp AT TIME ZONE ''UTC'')::date < CURRENT_DATE'
                    else regexp_replace(sql_text, '\\s+', ' ', 'g') end) body
          from spelled),
        checked as (
          select query_id, len(items) total,
                 len([x for x in items if not contains(body, regexp_replace(lower(x), '\\s+', ' ', 'g'))
                      and not contains(body, regexp_replace(regexp_replace(lower(x), '\\s+', ' ', 'g'),
                                                            '\\b[a-z_]+\\.', '', 'g'))]) missing
          from scoped)
        select query_id, {_grade('missing', 'total')} grade from checked""",
    "x_grade_aggregation": f"""
        , checked as (
          select query_id, len(items) total, len([x for x in items if not case
              when x = 'COUNT' then tpl in (2, 15, 28, 105) when x = 'AVG' then tpl = 11
              when x = 'GROUP BY order_status' then tpl in (11, 15) when x = 'ORDER BY days' then tpl in (11, 19)
              when x = 'LIMIT 5' then tpl in (6, 11, 106) or (tpl = 15 and contains(cast(query_id % 90 as varchar), '5'))
              when x = 'LIMIT 100' then tpl = 22
              when x = 'SUM(CASE x)' then false when x = 'DISTINCT id' then false else true end]) missing
          from x_cell_aggregation)
        select query_id, {_grade('missing', 'total')} grade from checked""",
    "x_grade_join": """
        select query_id, case when cell = 3 then 'NA'
               when (cell = 0 and tpl in (11, 23, 24, 101)) or (cell = 1 and tpl = 15) or (cell = 2 and tpl = 13) then 'flag'
               else 'correct' end grade
        from x_cell_join""",
    "x_grade_date_operator": """
        select query_id, case when cell in (2, 4) then 'NA' when (cell = 0 and tpl in (11, 27, 104)) or (cell = 1 and tpl = 27) then 'correct'
               when cell = 1 and tpl in (11, 104, 107) then 'flag' else 'wrong' end grade
        from x_cell_date_operator""",
    "x_grade_time_frame": """
        select query_id, case when cell in (0, 3) then 'NA' when cell = 1 and tpl = 11 then 'correct'
               when cell = 2 and tpl = 11 then 'flag' when cell = 4 and tpl in (2, 11, 15, 28, 105) then 'flag'
               else 'wrong' end grade
        from x_cell_time_frame""",
}
for _name in ("table", "filters", "aggregation"):
    VIEWS[f"x_grade_{_name}"] = VIEWS[f"x_grade_{_name}"].replace(", checked", "with checked", 1).replace(
        ", spelled", "with spelled", 1)

BODIES = {
    "log_statement_kind": """
        select query_id, k as kind, case when k in ('SELECT', 'WITH') then 1 else 0 end as allowed
        from (select query_id, case tpl when 3 then 'DROP' when 12 then 'WITH' when 14 then '' when 21 then 'UNION' else 'SELECT' end k
              from x_query_log)""",
    "log_forbidden_keyword": f"""
        select query_id, unnest(list_distinct(regexp_extract_all(upper(sql_text), {_FORBIDDEN}))) as word
        from x_query_log""",
    "log_system_catalog": "select query_id from x_query_log where tpl in (4, 9, 16)",
    "log_allow_list": """
        select query_id, case tpl when 4 then 'pg_tables' when 8 then 'unknown_table' when 9 then 'tables'
               when 12 then 'recent' when 16 then 'pg_shadow' else 'secret_table' end as table_name
        from x_query_log where tpl in (4, 8, 9, 12, 16, 17, 18, 23, 24, 101, 102)""",
    "log_trap_table": "select query_id from x_query_log where tpl = 5",
    "log_select_star": "select query_id from x_query_log where tpl in (1, 13)",
    "log_limit_rule": """
        , flagged as (
          select query_id, tpl, sql_text, tpl in (2, 11, 15, 28, 105) grouped,
                 tpl in (6, 11, 15, 17, 19, 20, 21, 22, 23, 24, 25, 26, 100, 101, 102, 103, 104, 106)
                 or regexp_matches(sql_text, '(?i)\\blimit\\s+\\d+') limited
          from x_query_log)
        select query_id, cast(grouped as int) as has_aggregation, cast(limited as int) as has_limit,
               case when grouped or limited then sql_text when tpl = 14 then ' LIMIT 1000' else sql_text || ' LIMIT 1000' end as sql_text
        from flagged""",
    "log_table_usage": r"""
        select table_name, count(*) as n_queries
        from (select distinct query_id, unnest([lower(t) for t in regexp_extract_all(sql_text,
                '(?i)\b(?:FROM|JOIN)\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1)]) table_name from x_query_log)
        group by 1""",
    "log_soft_fk_warning": "select query_id from x_query_log where tpl = 7",
    "log_unknown_columns": """
        select query_id, case tpl when 5 then 'geolocation.zip' when 6 then 'products.product_name'
               when 106 then 'orders.nothing'
               else 'geolocation_by_zip.*' end as column_name
        from x_query_log where tpl in (5, 6, 13, 106)""",
    "log_policy_verdict": """
        select query_id, cast(failures = '' as int) as valid, failures as rule_failures, warnings from x_judged""",
    "log_rule_rollup": """
        select rule, count(*) as n from (select unnest(string_split(failures, ',')) rule from x_judged) where rule <> '' group by 1""",
    "log_api_gate": f"""
        , cut as (select query_id, trim(sql_text, chr(10) || ' ') t from x_query_log),
        judged as (select query_id, t, case when t = '' then 'empty' when not starts_with(upper(t), 'SELECT') then 'not select'
                     {' '.join(f"when contains(upper(t), '{w}') then 'forbidden {w}'" for w in _GATE)} else 'ok' end verdict from cut)
        select query_id, verdict, case when verdict <> 'ok' then null when contains(upper(t), 'LIMIT') then t
               else rtrim(t, ';') || ' LIMIT 10000' end as sql_text
        from judged""",
    "log_extract_fenced_sql": """
        , cut as (select query_id, trim(sql_text, chr(10) || ' ') t from x_query_log)
        select query_id, t as extracted, case when query_id % 2 = 1 then t when t = '' then 'Here it is:' || chr(10) || 'Done.'
               else 'Here it is:' || chr(10) || t || chr(10) || 'Done.' end as unfenced
        from cut""",
    "em_normalize_sql": f"select query_id, {_normal('sql_text')} as normalized from x_query_log",
    "em_exact_match": f"""
        , guessed as (
          select query_id, sql_text gold, case query_id % 5 when 0 then sql_text
                   when 1 then chr(10) || ' ' || translate(sql_text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ' ;'
                   when 2 then replace(sql_text, 'order_id', '"order_id"') when 3 then ' ' || sql_text || '  '
                   else sql_text || ' x' end guess
          from x_query_log)
        select query_id, cast({_normal('gold')} = {_normal('guess')} as int) as em,
               cast(trim(gold, chr(10) || ' ') = trim(guess, chr(10) || ' ') as int) as em_raw
        from guessed""",
    "rubric_verdict": """
        , every as (select * from x_grade_table union all select * from x_grade_filters
                    union all select * from x_grade_aggregation union all select * from x_grade_join
                    union all select * from x_grade_date_operator union all select * from x_grade_time_frame)
        select query_id, cast(bool_or(grade = 'wrong') as int) as any_wrong,
               cast(bool_or(grade = 'flag') as int) as any_flag
        from every group by 1""",
}
for _name in CELLS:
    BODIES[f"rubric_{_name}"] = f"select query_id, grade from x_grade_{_name}"
