"""Oracle bodies for result-set comparison, written out for the fixed column list."""

VIEWS = {
    "x_gold": """
        select i.seller_id case_id, i.product_id c0, count(*) c1,
               cast(sum(i.price + i.freight_value) as double) c2, any_value(p.product_category_name) c3, 4 width
        from x_items i join x_products p on p.product_id = i.product_id group by 1, 2""",
    "x_guess": """
        select case_id, c0, c1,
               case when case_id % 7 = 1 then c2 * 1.005 when case_id % 7 = 2 and c0 % 100 < 2 then c2 * 1.05
                    else c2 end c2,
               case when case_id % 7 = 5 then coalesce(c3, 'none') when case_id % 7 = 6 and c0 % 100 < 2 then upper(c3)
                    else c3 end c3,
               case when case_id % 7 = 4 then 5 else 4 end width
        from x_gold where case_id % 7 <> 3 or c0 % 100 >= 2""",
    "x_cases": """
        select s_suppkey case_id from supplier
        union all select s_suppkey + 1000000 from supplier where s_suppkey % 10 = 0""",
    "x_ranked_gold": """
        select *, row_number() over (partition by case_id order by c0, c1, round(c2, 6), c3 nulls first) - 1 place
        from x_gold""",
    "x_ranked_guess": """
        select *, row_number() over (partition by case_id order by c0, c1, round(c2, 6), c3 nulls first) - 1 place
        from x_guess""",
    "x_value_diff": """
        select g.case_id, min(g.place * 10 + case
                 when abs(g.c0 - p.c0) > 0.01 * greatest(abs(g.c0), abs(p.c0)) then 0
                 when abs(g.c1 - p.c1) > 0.01 * greatest(abs(g.c1), abs(p.c1)) then 1
                 when abs(g.c2 - p.c2) > 0.01 * greatest(abs(g.c2), abs(p.c2)) then 2
                 when g.c3 is distinct from p.c3 then 3 end) spot
        from x_ranked_gold g join x_ranked_guess p on p.case_id = g.case_id and p.place = g.place group by 1""",
    "x_shape_gold": "select case_id, count(*) n, max(width) w from x_gold group by 1",
    "x_shape_guess": "select case_id, count(*) n, max(width) w from x_guess group by 1",
    "x_verdict": """
        select c.case_id, coalesce(g.n, 0) gold_rows, coalesce(p.n, 0) predicted_rows, coalesce(g.w, 0) gw,
               coalesce(p.w, 0) pw, d.spot
        from x_cases c left join x_shape_gold g on g.case_id = c.case_id
        left join x_shape_guess p on p.case_id = c.case_id left join x_value_diff d on d.case_id = c.case_id""",
    "x_compared": """
        select *, case when gold_rows <> predicted_rows then 'row count' when gw <> pw then 'col count'
                       when spot is not null then 'value' when gold_rows = 0 then 'both empty' else 'equal' end reason
        from x_verdict""",
    "x_compared_trimmed": """
        select *, case when gold_rows <> predicted_rows then 'row count'
                       when spot is not null then 'value' when gold_rows = 0 then 'both empty' else 'equal' end reason
        from x_verdict""",
    "x_row_keys": """
        select case_id, 1 side, c0 || '|' || c1 || '|' || c2 || '|' || coalesce(c3, '<null>') || '|' || width line
        from x_gold
        union all
        select case_id, 2, c0 || '|' || c1 || '|' || c2 || '|' || coalesce(c3, '<null>') || '|' || width from x_guess""",
}

_REPORT = """
    select case_id, case when reason in ('equal', 'both empty') then 1 else 0 end as is_equal, reason,
           gold_rows, predicted_rows,
           cast(case reason when 'value' then spot // 10 when 'col count' then 0 else -1 end as bigint) as row_no,
           cast(case reason when 'value' then spot % 10 else -1 end as bigint) as col_no
    from {}"""

BODIES = {
    "resultset_compare": _REPORT.format("x_compared"),
    "resultset_compare_trimmed": _REPORT.format("x_compared_trimmed"),
    "eval_reason_rollup": "select reason, count(*) as n_cases from x_compared group by 1",
    "resultset_exact_diff": """
        , netted as (select case_id, line, count(*) filter (where side = 1) - count(*) filter (where side = 2) extra
                     from x_row_keys group by 1, 2)
        select case_id, cast(coalesce(sum(extra) filter (where extra > 0), 0) as bigint) as gold_only,
               cast(coalesce(-sum(extra) filter (where extra < 0), 0) as bigint) as predicted_only
        from netted where extra <> 0 group by 1""",
}
