"""Every runnable query by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.plans import comparing, counting, delivery, ingest, querylog, sales, scoring, service
from tallyhouse.plans.star import Star
from tallyhouse.session import tune

THEMES = {
    counting: """
        e02_top_cities_by_customers e04_unique_customers e05_average_review_score e07_total_orders
        e08_unique_customers_named e09_distinct_categories e10_total_sellers e11_total_payments
        e12_total_reviews e13_top_states_by_customers e14_top_states_by_sellers e15_orders_by_status
        e16_total_line_items h02_repeat_customer_rate m06_payment_method_share
        m07_top_cities_unique_customers m08_monthly_order_count m12_review_score_distribution
        m13_orders_per_customer_distribution ex04_canceled_before_approval
        ex09_orders_per_seller_distribution exl04_unique_customers_in_year order_date_parts
        dataset_max_date
    """,
    sales: """
        e01_top_products_in_category e03_payment_methods_in_category h01_average_lifetime_value
        h03_top_sellers_states_served h05_payment_share_top5_categories h07_multi_category_order_rate
        h08_top_state_category_revenue h09_monthly_average_order_value m03_average_order_value_by_state
        m04_top_categories_revenue m09_average_payment_by_type m10_top_sellers_revenue
        ex01_revenue_by_state ex02_item_value_by_category ex03_top_sellers_by_items
        ex05_basket_size_by_state ex10_total_payment_by_type ex11_sellers_by_categories
        ex13_sellers_4hop_date_range ex14_seller_share_in_state ex15_top_categories_by_items
        exl08_order_value_by_state_with_n exl16_monthly_aov_category denominator_pattern_category_count
        order_totals payment_value_spread metric_catalog sample_filter_limit sample_join_projection
        sample_state_counts sample_item_total sample_payment_totals
    """,
    service: """
        e06_late_orders_count h04_worst_late_rate_categories h06_review_on_time_vs_late
        h10_average_review_lag_days m01_slowest_delivery_states m02_on_time_rate
        m05_worst_reviewed_categories m11_on_time_rate_overall ex06_latest_review_per_order
        ex08_review_by_basket_type ex12_latest_review_per_customer exl05_delivery_days_by_state
        exl15_top_categories_by_reviews
    """,
    ingest: """
        ingest_csv_scan ingest_lenient_cast ingest_timestamp_formats ingest_first_wins_dedupe
        ingest_full_refresh ingest_table_load geolocation_by_zip table_row_counts geo_zip_join_safe fk_orphan_audit
        inner_join_drop_audit row_cap_with_flag
    """,
    comparing: """
        resultset_compare resultset_compare_trimmed resultset_exact_diff eval_reason_rollup
    """,
    scoring: """
        eval_token_cost eval_combine_dims eval_outcome eval_case_filter eval_latency_percentiles
        eval_run_summary eval_by_difficulty eval_by_dimension eval_dimension_health
        eval_cost_latency_by_difficulty eval_false_positives eval_failure_list eval_pending_cases
        eval_rerun_failures eval_results_sorted eval_run_delta eval_latest_run run_id_slug case_slug
        case_id_assignment rubric_items_split ground_truth_shape case_tags case_quality_check
        case_quality_totals
    """,
    delivery: """
        ledger_tolerant_read ledger_append results_csv_sink results_case_split results_run_document
    """,
    querylog: """
        em_normalize_sql em_exact_match log_statement_kind log_forbidden_keyword log_system_catalog
        log_allow_list log_trap_table log_select_star log_limit_rule log_table_usage
        log_soft_fk_warning log_unknown_columns log_policy_verdict log_rule_rollup log_api_gate
        log_extract_fenced_sql rubric_table rubric_filters rubric_aggregation rubric_join
        rubric_date_operator rubric_time_frame rubric_verdict
    """,
}

# Queries whose name is also the name of a building block.
RENAMED = {
    "order_totals": sales.order_totals_report,
    "ground_truth_shape": scoring.ground_truth_report,
}

Query = Callable[[SparkSession, str], DataFrame]


def _bound(program: Callable[[Star], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return program(Star(tune(spark), folder))

    run.__name__ = program.__name__
    run.__doc__ = program.__doc__
    return run


def all_queries() -> dict[str, Query]:
    found = {}
    for theme, names in THEMES.items():
        for name in names.split():
            found[name] = _bound(RENAMED.get(name) or getattr(theme, name))
    return dict(sorted(found.items()))
