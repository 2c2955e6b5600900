"""Oracle bodies for the ledger and the delivered files."""

BODIES = {
    "ledger_tolerant_read": """
        select cast(query_id as varchar) as query_id, run_no, ex, latency_sec, status
        from x_result where query_id % 50 <> 0 and query_id % 53 <> 0 and query_id % 59 <> 0""",
    "ledger_append": """
        select run_no, count(*) as n_records, count(*) filter (where status = 'pass') as n_passed
        from x_result group by 1""",
    "results_csv_sink": """
        select cast(r.query_id as varchar) as query_id, cast(null as varchar) as question, cast(em as varchar) as em,
               cast(ex as varchar) as ex, latency_sec,
               cast(input_tokens as varchar) as input_tokens, cast(output_tokens as varchar) as output_tokens,
               cast(cost_usd as double) as cost_usd, status, d_table as "table", d_time_frame as time_frame,
               d_filters as filters, d_aggregation as aggregation, d_join as "join",
               difficulty, cast(null as varchar) as gold_sql, nullif(l.sql_text, '') as predicted_sql,
               nullif(error, '') as error, cast(null as varchar) as ground_truth_rows
        from x_result r join x_query_log l on l.query_id = r.query_id""",
    "results_case_split": """
        select case when status = 'pass' then 'passes' else 'failures' end as part, difficulty, count(*) as n_cases,
               cast(sum(ex) as bigint) as n_right, count(*) filter (where d_table = 'wrong') as n_table_wrong,
               count(*) filter (where d_join = 'wrong') as n_join_wrong,
               cast(sum(length(l.sql_text)) as bigint) as sql_chars
        from x_result r join x_query_log l on l.query_id = r.query_id group by 1, 2""",
    "results_run_document": """
        select run_no, 'run_no_' || run_no as run_id, 'Run No. ' || run_no as name, 'full' as mode, count(*) as total,
               count(*) filter (where status = 'pass') as passed, count(*) filter (where outcome = 'review') as review,
               count(*) filter (where status = 'fail') as failed, count(*) filter (where status = 'error') as errors,
               count(*) filter (where status = 'timeout') as timeouts,
               round(count(*) filter (where status = 'pass') / count(*), 4) as pass_rate,
               round(avg(ex), 4) as ex_rate, round(avg(em), 4) as em_rate,
               round(cast(sum(cost_usd) as double), 6) as total_cost_usd,
               count(*) filter (where status = 'pass') as n_passes, count(*) filter (where status <> 'pass') as n_failures,
               count(*) filter (where status = 'pass') as found_passes,
               count(*) filter (where status <> 'pass') as found_failures,
               cast(sum(query_id) filter (where status = 'pass') as bigint) as passes_sum
        from x_result group by 1""",
}
