"""Oracle bodies for loading, conforming and load audits."""

BODIES = {
    "ingest_csv_scan": """
        select cast(doc_id as varchar) as review_id, 'o' || doc_id as order_id,
               cast(doc_id % 5 + 1 as int) as review_score,
               case when doc_id % 3 <> 0 then 'say "' || lang || '", twice' end as review_comment_title,
               md5(message) as message_md5, cast(length(message) as int) as message_chars
        from (select *, case when doc_id % 4 = 1 then chr(10) || '  ' || text || '  ' || chr(10) else text end message
              from documents)""",
    "ingest_lenient_cast": """
        select cast(p_partkey as varchar) as product_id,
               case when p_partkey % 40 <> 0 then p_brand end as product_category_name,
               cast(case when p_partkey % 21 in (6, 13) then null else case p_partkey % 7 when 1 then null when 2 then null when 4 then -p_size
                    when 5 then p_size * 10 else p_size end end as int) as product_weight_g
        from part""",
    "ingest_timestamp_formats": """
        select cast(o_orderkey as varchar) as order_id,
               case o_orderkey % 5 when 0 then strftime(o_orderdate + interval 1 hour, '%Y-%m-%d %H:%M:%S')
                    when 1 then strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' end as order_purchase_timestamp
        from orders""",
    "ingest_first_wins_dedupe": """
        select distinct on (l_orderkey, l_linenumber)
               l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
        from lineitem
        order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity,
                 l_discount, l_tax""",
    "ingest_table_load": """
        select cast(o_orderkey as varchar) as order_id, cast(o_orderkey % 3 + 1 as int) as payment_sequential,
               ' ' || chr(10) || o_orderpriority as payment_type,
               cast(case when o_orderkey % 4 = 0 then 3 end as int) as payment_installments,
               cast(o_totalprice as decimal(10,2)) as payment_value
        from orders""",
    "geolocation_by_zip": """
        , cities as (select zip, city, row_number() over (partition by zip order by count(*) desc, city) place
                     from x_geo where city is not null group by zip, city),
        states as (select zip, state, row_number() over (partition by zip order by count(*) desc, state) place
                   from x_geo where state is not null group by zip, state)
        select g.zip, round(avg(g.lat), 6) as lat, round(avg(g.lng), 6) as lng, any_value(c.city) as city,
               any_value(s.state) as state
        from x_geo g left join cities c on c.zip = g.zip and c.place = 1
        left join states s on s.zip = g.zip and s.place = 1 group by g.zip""",
    "table_row_counts": """
        , counted as (
          select 'customers' table_name, (select count(*) from x_customers) n, 99000 minimum
          union all select 'sellers', (select count(*) from x_sellers), 3000
          union all select 'products', (select count(*) from x_products), 32000
          union all select 'product_category_translation', (select count(*) from x_translation), 70
          union all select 'orders', (select count(*) from x_orders), 99000
          union all select 'order_items', (select count(*) from x_items), 110000
          union all select 'order_payments', (select count(*) from x_payments), 100000
          union all select 'order_reviews', (select count(*) from x_reviews), 98000
          union all select 'geolocation', (select count(*) from x_geo), 900000)
        select table_name, n, cast(minimum as bigint) as minimum,
               case when n >= minimum then 1 else 0 end as ok from counted""",
    "geo_zip_join_safe": """
        select 'nothing' as joined_to, count(*) as n_rows from x_customers
        union all select 'geolocation_by_zip', count(*) from x_customers
          join (select distinct zip from x_geo) z on z.zip = customer_zip_code_prefix
        union all select 'geolocation', count(*) from x_customers join x_geo g on g.zip = customer_zip_code_prefix""",
    "fk_orphan_audit": """
        select 'orders.customer_id' as relationship, count(*) as n_rows,
               count(*) filter (where customer_id not in (select customer_id from x_customers)) as n_orphans
        from x_orders
        union all select 'order_items.product_id', count(*),
               count(*) filter (where product_id not in (select product_id from x_products)) from x_items
        union all select 'order_items.seller_id', count(*),
               count(*) filter (where seller_id not in (select seller_id from x_sellers)) from x_items
        union all select 'order_payments.order_id', count(*),
               count(*) filter (where order_id not in (select order_id from x_orders)) from x_payments
        union all select 'order_reviews.order_id', count(*),
               count(*) filter (where event_id * 2 not in (select order_id from x_orders)) from events
        union all select 'products.product_category_name', count(*),
               count(*) filter (where product_category_name not in (select product_category_name from x_translation))
        from x_products""",
    "inner_join_drop_audit": """
        select count(*) as n_items, count(*) filter (where english_name is null) as n_items_lost,
               cast(sum(amount) filter (where english_name is null) as double) as revenue_lost
        from x_lines""",
    "row_cap_with_flag": """
        select order_id, order_status, case when (select count(*) from x_orders) > 1000 then 1 else 0 end as truncated
        from x_orders order by order_id limit 1000""",
}
BODIES["ingest_full_refresh"] = BODIES["geolocation_by_zip"]
