"""Oracle bodies for counting, sales and service queries (views are added by ``statement``)."""


def _mean(amount: str) -> str:
    """Mean of a two-digit decimal rounded to two digits in whole cents, so exact halves go up."""
    cents = f"cast(sum({amount}) * 100 as hugeint)"
    return f"cast((2 * {cents} + count(*)) // (2 * count(*)) as double) / 100"


_DAYS = "cast(trunc(date_diff('second', {a}, {b}) / 86400.0) as bigint)"

BODIES = {
    # -- counts -----------------------------------------------------------------------
    "e04_unique_customers": "select count(distinct customer_unique_id) as count from x_customers",
    "e05_average_review_score": "select round(avg(review_score), 4) as round from x_reviews",
    "e07_total_orders": "select count(*) as n from x_orders",
    "e08_unique_customers_named": "select count(distinct customer_unique_id) as n from x_customers",
    "e09_distinct_categories": "select count(distinct product_category_name) as n from x_products",
    "e10_total_sellers": "select count(*) as n from x_sellers",
    "e11_total_payments": "select count(*) as n from x_payments",
    "e12_total_reviews": "select count(*) as n from x_reviews",
    "e15_orders_by_status": "select order_status, count(*) as n from x_orders group by all order by n desc, 1",
    "e16_total_line_items": "select count(*) as n from x_items",
    "e02_top_cities_by_customers": """
        select city as customer_city, count(distinct person) as n_customers from x_buyers
        group by city order by n_customers desc, city limit 10""",
    "e13_top_states_by_customers": """
        select state as customer_state, count(distinct person) as n from x_buyers
        group by state order by n desc, state limit 5""",
    "m07_top_cities_unique_customers": """
        select city as customer_city, count(distinct person) as n_unique_customers from x_buyers
        group by city order by n_unique_customers desc, city limit 10""",
    "e14_top_states_by_sellers": """
        select seller_state, count(*) as n from x_sellers group by 1 order by n desc, 1 limit 5""",
    "h02_repeat_customer_rate": """
        select round(100.0 * avg(case when k > 1 then 1 else 0 end), 2) as repeat_pct
        from (select person, count(distinct customer_id) k from x_buyers group by person)""",
    "m13_orders_per_customer_distribution": """
        select n_orders, count(*) as n_customers
        from (select person, count(distinct customer_id) n_orders from x_buyers group by person)
        group by n_orders order by n_orders""",
    "ex09_orders_per_seller_distribution": """
        select n_orders, count(*) as n_sellers
        from (select seller_id, count(distinct order_id) n_orders from x_items group by seller_id)
        group by n_orders order by n_orders""",
    "m06_payment_method_share": """
        select payment_type, n, round(100.0 * n / sum(n) over (), 2) as pct
        from (select payment_type, count(*) n from x_payments group by 1) order by n desc, payment_type""",
    "m08_monthly_order_count": """
        select strftime(order_purchase_timestamp, '%Y-%m') as ym, count(*) as n from x_orders group by 1 order by 1""",
    "m12_review_score_distribution": """
        select review_score, count(*) as n from x_reviews group by 1 order by 1""",
    "ex04_canceled_before_approval": """
        select count(*) filter (where order_approved_at is null) as canceled_before_approval
        from x_orders where order_status = 'canceled'""",
    "exl04_unique_customers_in_year": """
        select count(distinct person) as unique_customers from x_buyers where year(placed) = 1997""",
    "order_date_parts": """
        select cast(year(t) as int) as year, cast(month(t) as int) as month, cast(dayofweek(t) as int) as dow,
               count(*) as n
        from (select order_purchase_timestamp t from x_orders) group by all""",
    "dataset_max_date": """
        select strftime(max(order_purchase_timestamp), '%Y-%m-%d') as max_date from x_orders""",
    # -- products and categories ------------------------------------------------------
    "e01_top_products_in_category": """
        select product_id, count(*) as n_sold from x_lines where english_name = 'brand_9'
        group by product_id order by n_sold desc, product_id limit 5""",
    "m04_top_categories_revenue": """
        select english_name as category, cast(sum(amount) as double) as revenue from x_lines
        group by 1 order by revenue desc nulls first, category nulls last limit 5""",
    "ex02_item_value_by_category": f"""
        select best_name as category, {_mean('amount')} as avg_order_value from x_lines
        group by 1 order by avg_order_value desc, category nulls last limit 20""",
    "ex15_top_categories_by_items": """
        select best_name as category, count(*) as item_count from x_lines
        group by 1 order by item_count desc, category nulls last limit 5""",
    "h07_multi_category_order_rate": """
        select round(100.0 * count(*) filter (where kinds >= 2) / count(*), 2) as pct_multi_category
        from (select l.order_id, count(distinct english_name) kinds from x_lines l
              join x_orders o on o.order_id = l.order_id group by 1 having count(*) >= 2)""",
    "denominator_pattern_category_count": """
        select round(100.0 * count(*) filter (where kinds >= 2) / count(*), 2) as pct
        from (select order_id, count(distinct raw_name) kinds from x_lines group by 1 having count(*) > 1)""",
    "h08_top_state_category_revenue": """
        select b.state as customer_state, l.english_name as category, cast(sum(l.amount) as double) as revenue
        from x_lines l join x_buyers b on b.order_id = l.order_id
        group by 1, 2 order by revenue desc, customer_state, category nulls last limit 5""",
    # -- customers and places ---------------------------------------------------------
    "h01_average_lifetime_value": f"""
        select {_mean('spent')} as avg_ltv
        from (select b.person, sum(i.price + i.freight_value) spent from x_buyers b
              join x_items i on i.order_id = b.order_id group by b.person)""",
    "m03_average_order_value_by_state": f"""
        select b.state as customer_state, {_mean('v.total')} as avg_gmv
        from x_order_value v join x_buyers b on b.order_id = v.order_id
        group by 1 order by avg_gmv desc, 1 limit 5""",
    "exl08_order_value_by_state_with_n": f"""
        select b.state as customer_state, {_mean('v.total')} as avg_gmv, count(*) as n_orders
        from x_order_value v join x_buyers b on b.order_id = v.order_id
        group by 1 order by avg_gmv desc, 1 limit 5""",
    "ex01_revenue_by_state": """
        select b.state as customer_state, cast(sum(i.price + i.freight_value) as double) as revenue
        from x_items i join x_buyers b on b.order_id = i.order_id group by 1 order by revenue desc, 1 limit 27""",
    "ex05_basket_size_by_state": """
        select b.state as customer_state, round(avg(v.n_items), 2) as avg_items
        from x_order_value v join x_buyers b on b.order_id = v.order_id
        where b.order_status = 'delivered' group by 1 order by avg_items desc, 1 limit 5""",
    # -- months -----------------------------------------------------------------------
    "h09_monthly_average_order_value": f"""
        select strftime(o.order_purchase_timestamp, '%Y-%m') as ym, {_mean('v.total')} as avg_order_value,
               count(*) as n_orders
        from x_order_value v join x_orders o on o.order_id = v.order_id group by 1 order by 1""",
    "exl16_monthly_aov_category": f"""
        select strftime(d.placed, '%Y-%m') as ym, {_mean('v.total')} as avg_order_value, count(*) as n_orders
        from (select order_id, sum(amount) total from x_lines where english_name = 'brand_9' group by 1) v
        join x_delivered d on d.order_id = v.order_id group by 1 order by 1""",
    # -- sellers ----------------------------------------------------------------------
    "m10_top_sellers_revenue": """
        select s.seller_id, cast(sum(i.price + i.freight_value) as double) as revenue
        from x_items i join x_sellers s on s.seller_id = i.seller_id group by 1 order by revenue desc, 1 limit 10""",
    "ex03_top_sellers_by_items": """
        select s.seller_id, count(*) as items_sold from x_items i join x_sellers s on s.seller_id = i.seller_id
        group by 1 order by items_sold desc, 1 limit 5""",
    "h03_top_sellers_states_served": """
        select s.seller_id, count(distinct b.state) as n_states
        from x_sellers s join x_items i on i.seller_id = s.seller_id join x_buyers b on b.order_id = i.order_id
        group by 1 order by n_states desc, 1 limit 5""",
    "ex11_sellers_by_categories": """
        select s.seller_id, count(distinct l.english_name) as n_categories
        from x_sellers s join x_lines l on l.seller_id = s.seller_id
        group by 1 having count(*) >= 600 order by n_categories desc, 1 limit 5""",
    "ex13_sellers_4hop_date_range": """
        select s.seller_id, count(*) as items_sold
        from x_lines l join x_buyers b on b.order_id = l.order_id join x_sellers s on s.seller_id = l.seller_id
        where b.state = 'NATION_3' and l.english_name = 'brand_9' and year(b.placed) = 1997
        group by 1 order by items_sold desc, 1 limit 3""",
    "ex14_seller_share_in_state": """
        select seller_state, seller_id, k as items_sold,
               round(100.0 * k / sum(k) over (partition by seller_state), 2) as pct_of_state_items
        from (select s.seller_state, s.seller_id, count(*) k from x_items i
              join x_sellers s on s.seller_id = i.seller_id group by 1, 2)""",
    # -- payments ---------------------------------------------------------------------
    "e03_payment_methods_in_category": """
        select p.payment_type, count(*) as n
        from x_payments p join x_orders o on o.order_id = p.order_id join x_lines l on l.order_id = o.order_id
        where l.english_name = 'brand_9' group by 1 order by n desc, 1""",
    "h05_payment_share_top5_categories": """
        , best as (select best_name, sum(amount) revenue from x_lines group by 1
                   order by revenue desc, best_name nulls last limit 5),
        paid as (select l.best_name category, p.payment_type, sum(p.payment_value) v
                 from x_lines l join x_orders o on o.order_id = l.order_id
                 join x_payments p on p.order_id = o.order_id
                 where l.best_name in (select best_name from best) group by 1, 2)
        select category, payment_type, cast(v as double) as payment_value,
               round(v * 100.0 / sum(v) over (partition by category), 2) as payment_share_pct
        from paid""",
    "m09_average_payment_by_type": f"""
        select payment_type, {_mean('payment_value')} as avg_value, count(*) as n from x_payments group by 1""",
    "ex10_total_payment_by_type": """
        select payment_type, cast(sum(payment_value) as double) as total_value, count(*) as n
        from x_payments group by 1""",
    "payment_value_spread": """
        select payment_type, min(v) as min_value, max(v) as max_value, round(stddev_samp(v), 4) as stddev_value,
               round(var_samp(v), 2) as variance_value
        from (select payment_type, cast(payment_value as double) v from x_payments) group by 1""",
    # -- metrics and samples ----------------------------------------------------------
    "metric_catalog": """
        select 'revenue' as metric, cast(sum(price) as double) as value from x_items
        union all select 'order_count', cast(count(distinct order_id) as double) from x_orders
        union all select 'customer_count', cast(count(distinct customer_unique_id) as double) from x_customers
        union all select 'average_order_value', round(avg(total), 4) from x_order_value
        union all select 'review_score', round(avg(review_score), 4) from x_reviews""",
    "order_totals": "select order_id, cast(total as double) as total_value from x_order_value",
    "sample_filter_limit": "select * from x_orders where order_status = 'delivered' order by order_id limit 10",
    "sample_join_projection": """
        select order_id, city as customer_city, order_status from x_buyers order by order_id limit 5""",
    "sample_state_counts": """
        select state as customer_state, count(*) as count from x_buyers group by 1 order by count desc, 1 limit 5""",
    "sample_item_total": """
        select order_id, order_item_id, cast(price as double) as price, cast(freight_value as double) as freight_value,
               cast(price + freight_value as double) as total
        from x_items order by order_id, order_item_id, 3, 4 limit 5""",
    "sample_payment_totals": """
        select payment_type, count(*) as count, cast(sum(payment_value) as double) as total from x_payments group by 1""",
    # -- delivery and reviews ---------------------------------------------------------
    "e06_late_orders_count": "select count(*) as count from x_delivered where late",
    "m02_on_time_rate": """
        select round(100.0 * count(*) filter (where not late) / count(*), 2) as pct_on_time from x_delivered""",
    "m11_on_time_rate_overall": """
        select round(100.0 * avg(case when arrived <= promised then 1 else 0 end), 2) as pct_on_time from x_delivered""",
    "m01_slowest_delivery_states": f"""
        select state as customer_state, round(avg({_DAYS.format(a='placed', b='arrived')}), 2) as avg_days
        from x_buyers where order_status = 'delivered' and arrived is not null
        group by 1 order by avg_days desc, 1 limit 5""",
    "exl05_delivery_days_by_state": f"""
        select state as customer_state, round(avg({_DAYS.format(a='placed', b='arrived')}), 2) as avg_delivery_days
        from x_buyers where order_status = 'delivered' and arrived is not null
        group by 1 order by avg_delivery_days desc, 1 limit 27""",
    "h04_worst_late_rate_categories": """
        select best_name as category,
               round(100.0 * count(*) filter (where late) / count(distinct d.order_id), 2) as late_delivery_rate_pct,
               count(distinct d.order_id) as n_delivered_orders
        from x_delivered d join x_lines l on l.order_id = d.order_id
        group by 1 having count(distinct d.order_id) >= 600
        order by 2 desc, 3 desc, 1 nulls last limit 5""",
    "h06_review_on_time_vs_late": """
        select case when arrived <= promised then 'on_time' else 'late' end as delivery_status,
               round(avg(review_score), 3) as avg_score, count(*) as n
        from x_reviews r join x_delivered d on d.order_id = r.order_id group by 1""",
    "h10_average_review_lag_days": f"""
        select round(avg({_DAYS.format(a='d.arrived', b='r.review_creation_date')}), 2) as avg_review_lag_days,
               count(*) as n
        from x_reviews r join x_delivered d on d.order_id = r.order_id""",
    "m05_worst_reviewed_categories": """
        select english_name as category, round(avg(review_score), 2) as avg_score, count(*) as n_reviews
        from x_reviews r join x_lines l on l.order_id = r.order_id where english_name is not null
        group by 1 having count(*) >= 1500 order by avg_score, category limit 5""",
    "exl15_top_categories_by_reviews": """
        select best_name as category, round(avg(review_score), 2) as avg_score, count(*) as n_reviews
        from x_reviews r join x_lines l on l.order_id = r.order_id
        group by 1 having count(*) >= 1500 order by n_reviews desc, category nulls last limit 5""",
    "ex06_latest_review_per_order": """
        select avg(review_score) as avg_review_score
        from (select review_score, row_number() over
                (partition by order_id order by review_creation_date desc, review_id desc) place from x_reviews)
        where place = 1""",
    "ex12_latest_review_per_customer": """
        select avg(review_score) as avg_review_score
        from (select distinct on (o.customer_id) r.review_score
              from x_reviews r join x_orders o on o.order_id = r.order_id
              order by o.customer_id, r.review_creation_date desc, r.review_id desc)""",
    "ex08_review_by_basket_type": """
        select case when v.n_items = 1 then 'single_item' else 'multi_item' end as basket_type,
               round(avg(r.review_score), 3) as avg_score, count(*) as n
        from x_reviews r join x_order_value v on v.order_id = r.order_id group by 1""",
}
