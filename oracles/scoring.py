"""Oracle bodies for evaluation scoring and roll-ups."""

_DIMS = ("table", "filters", "aggregation", "join", "time_frame")


def _rest(key: str, modulus: int, pairs: dict[int, str], other: str) -> str:
    whens = " ".join(f"when {r} then '{v}'" for r, v in pairs.items())
    return f"case {key} % {modulus} {whens} else '{other}' end"


_ANY = "({})".format(" or ".join(f"d_{d} = '{{0}}'" for d in _DIMS))

VIEWS = {
    "x_raw": f"""
        select event_id query_id, user_id % 5 run_no,
               case when event_id % 3 = 0 then 'easy' when event_id % 3 = 1 then 'medium'
                    when user_id % 5 = 4 then 'easy' else 'hard' end difficulty,
               {_rest('event_id', 4, {0: 'gpt-4o', 1: 'gpt-4o-mini', 2: 'gpt-5.4'}, 'other')} model,
               cast(event_id % 97 = 0 as int) em, cast(event_type in ('click', 'view', 'purchase') as int) ex,
               case when event_id % 29 = 0 then 0.0 else round(value, 3) end latency_sec,
               5000 + event_id % 1000 input_tokens, 20 + event_id % 200 output_tokens,
               {_rest('event_id', 13, {0: 'wrong', 1: 'flag', 2: 'NA'}, 'correct')} d_table,
               {_rest('event_id', 7, {0: 'wrong', 1: 'flag', 2: 'NA'}, 'correct')} d_filters,
               {_rest('event_id', 17, {0: 'wrong', 1: 'flag', 2: 'NA', 3: 'NA'}, 'correct')} d_aggregation,
               {_rest('event_id', 11, {0: 'wrong', 1: 'flag'}, 'correct')} d_join,
               {_rest('event_id', 5, {0: 'NA', 1: 'NA', 2: 'flag'}, 'correct')} t_grade,
               {_rest('event_id', 6, {0: 'NA', 1: 'NA', 2: 'NA', 3: 'wrong'}, 'correct')} o_grade,
               event_id % 31 = 0 refused, event_id % 83 = 0 late, event_id % 61 = 0 crashed,
               case event_id % 14 when 3 then 'zip fan-out' when 8 then 'untranslated category' end trap
        from events""",
    "x_folded": """
        select *, case when 'wrong' in (t_grade, o_grade) then 'wrong' when 'flag' in (t_grade, o_grade) then 'flag'
                       when 'correct' in (t_grade, o_grade) then 'correct' else 'NA' end d_time_frame,
               round(case model when 'gpt-4o' then input_tokens * 2.5e-6 + output_tokens * 10e-6
                     when 'gpt-4o-mini' then input_tokens * 0.15e-6 + output_tokens * 0.6e-6
                     when 'gpt-5.4' then input_tokens * 2.5e-6 + output_tokens * 15e-6 else 0 end, 8) cost_usd
        from x_raw""",
    "x_result": f"""
        select *, {_ANY.format('wrong')} wrong, {_ANY.format('flag')} flagged,
               case when late then 'timeout' when refused or crashed then 'error'
                    when ex = 1 and not {_ANY.format('wrong')} then 'pass' else 'fail' end status,
               case when late or crashed then 'fail' when refused then 'error'
                    when ex = 1 and not {_ANY.format('wrong')} then
                      case when {_ANY.format('flag')} then 'review' else 'pass' end
                    else 'fail' end outcome,
               case when late then 'statement timeout' when crashed then 'ValueError: no answer'
                    when refused then 'refused by rule R7' else '' end error
        from x_folded""",
    "x_grades": " union all ".join(f"select run_no, '{d}' dimension, d_{d} grade from x_result" for d in _DIMS),
    "x_grade_counts": """
        select run_no, dimension, count(*) total, count(*) filter (where grade <> 'NA') graded,
               count(*) filter (where grade = 'correct') correct, count(*) filter (where grade = 'flag') flag,
               count(*) filter (where grade = 'wrong') wrong
        from x_grades group by 1, 2""",
    "x_runs": """
        select user_id, max(ts) started,
               case user_id % 5 when 0 then 'Baseline 4o-mini!' when 1 then 'Prompt v2' when 2 then 'baseline'
                    when 3 then '  GPT-5.4 (full 39)  ' else '***' end run_name,
               case user_id % 5 when 0 then 'baseline_4o_mini' when 1 then 'prompt_v2' when 2 then 'baseline'
                    when 3 then 'gpt_5_4_full_39' else '' end slug
        from events group by user_id""",
    "x_run_ids": """
        select *, case when slug = '' then '' else slug || '_' end || strftime(started, '%Y%m%d_%H%M%S') run_id
        from x_runs""",
    "x_questions": r"""
        select conv_id * 1000 + turn source_id, case conv_id % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end
                 difficulty,
               [w for w in regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+')
                if w <> ''] words
        from conversations where role = 'user'""",
    "x_slugs": """
        , kept as (select *, [w for w in words if w not in ('the', 'a', 'an', 'of', 'for', 'in', 'on', 'at', 'to',
                     'with', 'and', 'or', 'is', 'are', 'what', 'how', 'many', 'list', 'top', 'per')] rest
                   from x_questions)
        select source_id, difficulty,
               coalesce(nullif(array_to_string((case when len(rest) >= 2 then rest else words end)[1:5], '_'), ''),
                        'case') slug
        from kept""".replace(", kept", "with kept", 1),
    "x_drafts": "select event_id k, event_type from events",
}

_CELLS = ("table", "time_frame", "filters", "aggregation", "join", "date_operator")
_CHECKS = [
    ("k % 101 = 0", "absent:id"),
    ("k % 23 = 0", "absent:difficulty"),
    ("k % 31 = 0", "absent:tables"),
    ("k % 19 = 0", "absent:question"),
    ("k % 53 = 0", "absent:expected"),
    ("k % 23 = 0 or k % 29 = 0", "unknown:difficulty"),
    ("k % 17 = 0", "empty:gold_sql"),
]
for _i, _d in enumerate(_CELLS):
    _n = f"(k + {_i})"
    _live = f"{_n} % 37 <> 0 and {_n} % 41 <> 0 and {_n} % 3 <> 0"
    _CHECKS += [
        (f"{_n} % 37 = 0", f"absent:rubric.{_d}"),
        (f"{_n} % 37 <> 0 and {_n} % 41 = 0", f"absent:rubric.{_d}.required"),
        (f"{_live} and {_n} % 43 = 0", f"empty:rubric.{_d}.spec"),
        (f"{_live} and {_n} % 47 = 0", f"absent:rubric.{_d}.items"),
    ]
_ERRORS = ", ".join("case when {} then '{}' end".format(test, text.replace("'", "''")) for test, text in _CHECKS)
VIEWS["x_errors"] = f"select k, [e for e in [{_ERRORS}] if e is not null] errs from x_drafts"

BODIES = {
    "eval_token_cost": "select query_id, model, cast(cost_usd as double) as cost_usd from x_folded",
    "eval_combine_dims": """
        select t_grade as time_grade, o_grade as date_grade, d_time_frame as time_frame, count(*) as n
        from x_folded group by all""",
    "eval_outcome": "select query_id, run_no, status, outcome from x_result",
    "eval_case_filter": """
        select query_id, difficulty from x_raw
        where cast(query_id as varchar) like '12%' and difficulty = 'medium'""",
    "eval_latency_percentiles": """
        select run_no, round(quantile_cont(latency_sec, 0.5), 6) as p50_latency_sec,
               round(quantile_cont(latency_sec, 0.95), 6) as p95_latency_sec
        from x_raw where latency_sec <> 0 group by 1""",
    "eval_run_summary": """
        select run_no, count(*) as total, count(*) filter (where status = 'pass') as passed,
               count(*) filter (where status = 'fail') as failed, count(*) filter (where outcome = 'review') as review,
               count(*) filter (where status = 'error') as errors, count(*) filter (where status = 'timeout') as timeouts,
               round(count(*) filter (where status = 'pass') / count(*), 4) as pass_rate,
               round(avg(em), 4) as em_rate, round(avg(ex), 4) as ex_rate,
               round(count(*) filter (where not wrong) / count(*), 4) as rubric_clean_rate,
               round(count(*) filter (where wrong and ex = 1) / count(*), 4) as false_positive_rate,
               round(avg(latency_sec) filter (where latency_sec <> 0), 6) as avg_latency_sec,
               round(quantile_cont(latency_sec, 0.5) filter (where latency_sec <> 0), 6) as p50_latency_sec,
               round(quantile_cont(latency_sec, 0.95) filter (where latency_sec <> 0), 6) as p95_latency_sec,
               cast(sum(input_tokens) as bigint) as total_input_tokens,
               cast(sum(output_tokens) as bigint) as total_output_tokens,
               round(cast(sum(cost_usd) as double), 6) as total_cost_usd
        from x_result group by 1""",
    "eval_by_difficulty": """
        , stats as (select run_no, difficulty, count(*) n, round(avg(em), 4) em, round(avg(ex), 4) ex,
                           round(avg(case when status = 'pass' then 1 else 0 end), 4) pass_rate
                    from x_result group by 1, 2),
        domain as (select * from (select distinct run_no from x_result), (values ('easy'), ('medium'), ('hard')) v(difficulty))
        select d.run_no, d.difficulty, coalesce(s.n, 0) as n, coalesce(s.em, 0) as em, coalesce(s.ex, 0) as ex,
               coalesce(s.pass_rate, 0) as pass_rate
        from domain d left join stats s on s.run_no = d.run_no and s.difficulty = d.difficulty""",
    "eval_by_dimension": "select run_no, dimension, graded, correct, flag, wrong from x_grade_counts",
    "eval_dimension_health": """
        select run_no, dimension, graded, round(100.0 * correct / graded, 1) as correct_pct,
               round(100.0 * wrong / graded, 1) as wrong_pct, round(100.0 * flag / graded, 1) as flag_pct,
               round(100.0 * (total - graded) / total, 1) as na_pct
        from x_grade_counts""",
    "eval_cost_latency_by_difficulty": """
        select run_no, difficulty, round(avg(cast(cost_usd as double)), 6) as avg_cost_usd,
               round(avg(latency_sec), 3) as avg_latency_sec
        from x_result group by 1, 2""",
    "eval_false_positives": """
        select run_no, count(*) as n_false_positives from x_result where ex = 1 and wrong group by 1""",
    "eval_failure_list": """
        select r.query_id, r.run_no, r.difficulty, r.trap, r.em, r.ex,
               array_to_string([x for x in [case when d_table = 'wrong' then 'table' end,
                 case when d_filters = 'wrong' then 'filters' end, case when d_aggregation = 'wrong' then 'aggregation' end,
                 case when d_join = 'wrong' then 'join' end, case when d_time_frame = 'wrong' then 'time_frame' end]
                 if x is not null], ',') as wrong_dims,
               nullif(r.error, '') as error,
               left(l.sql_text, 200) as predicted_sql_excerpt
        from x_result r join x_query_log l on l.query_id = r.query_id where r.status <> 'pass'""",
    "eval_pending_cases": "select query_id, difficulty from x_raw where run_no >= 3",
    "eval_rerun_failures": """
        select query_id, difficulty from x_result where run_no = 1 and status <> 'pass'""",
    "eval_results_sorted": "select query_id, run_no, status from x_result order by 1",
    "eval_run_delta": """
        select query_id, status as before, case when status = 'pass' then 'fail' else 'pass' end as after,
               case when status = 'pass' then 'broken' else 'fixed' end as change
        from x_result
        where query_id % 10 = 3 and status in ('pass', 'fail')
          and not wrong""",
    "run_id_slug": "select user_id, run_name, slug, run_id from x_run_ids",
    "eval_latest_run": """
        select 'Baseline' as wanted, (select run_id from x_run_ids where starts_with(run_id, 'baseline_')
               or starts_with(run_id, 'Baseline') order by started desc, run_id desc limit 1) as run_id
        union all select 'prompt_v2_2024', (select run_id from x_run_ids where starts_with(run_id, 'prompt_v2_2024')
               order by started desc, run_id desc limit 1)
        union all select 'GPT-5.4 full 39', (select run_id from x_run_ids where starts_with(run_id, 'gpt_5_4_full_39_')
               order by started desc, run_id desc limit 1)
        union all select 'no such run', null""",
    "case_slug": "select source_id, slug from x_slugs",
    "case_id_assignment": """
        select source_id, difficulty, n as case_no, left(difficulty, 1) || printf('%02d', n) || '_' || slug as case_id
        from (select *, row_number() over (partition by difficulty order by source_id) n from x_slugs)""",
    "rubric_items_split": """
        , cells as (select p_partkey k, case p_partkey % 4
                      when 0 then p_name || ' ; ' || p_brand || ', ' || p_type || ';;'
                      when 1 then p_name || ' ,' || p_brand || ', ,' when 2 then '' else p_brand end c,
                      case p_partkey % 4 when 0 then [p_name, p_brand || ', ' || p_type] when 1 then [p_name, p_brand]
                        when 2 then null else [p_brand] end parts from part)
        select k as case_no, cast(c <> '' as int) as required, nullif(c, '') as spec,
               array_to_string(parts, '|') as items, cast(coalesce(len(parts), 0) as int) as n_items
        from cells""",
    "ground_truth_shape": """
        select o_orderkey as case_no,
               ['rows', 'rows', 'table', 'table', 'raw', 'raw', 'none', 'rows'][o_orderkey % 8 + 1] as form,
               cast([1, 2, 1, 1, -1, -1, -1, 0][o_orderkey % 8 + 1] as int) as n_rows,
               cast([1, 2, 2, 1, -1, -1, -1, 0][o_orderkey % 8 + 1] as int) as n_cols,
               case when o_orderkey % 8 in (0, 3) then cast(o_orderkey as varchar) end as scalar
        from orders""",
    "case_tags": """
        select tag, count(*) as n
        from (select unnest(case when n_chars > 1000 then [lang, source, 'long'] else [lang, source] end) tag from documents)
        group by 1""",
    "case_quality_check": """
        select k as case_no, cast(generate_subscripts(errs, 1) - 1 as int) as error_no, unnest(errs) as error
        from x_errors""",
    "case_quality_totals": """
        select count(*) filter (where len(errs) = 0) as n_valid, count(*) as n_cases from x_errors""",
}
