"""The shaped tables as SQL views, inlined into each oracle statement as CTEs."""

from __future__ import annotations

import re

VIEWS = {
    "x_customers": """
        select o.o_orderkey customer_id, c.c_custkey customer_unique_id,
               lpad(cast(c.c_custkey % 97 as varchar), 5, '0') customer_zip_code_prefix,
               n.n_name || '/' || c.c_mktsegment customer_city, n.n_name customer_state
        from orders o join customer c on o.o_custkey = c.c_custkey
        join nation n on c.c_nationkey = n.n_nationkey
        join region r on n.n_regionkey = r.r_regionkey""",
    "x_sellers": """
        select s.s_suppkey seller_id, n.n_name || '/' || r.r_name seller_city, n.n_name seller_state
        from supplier s join nation n on s.s_nationkey = n.n_nationkey
        join region r on n.n_regionkey = r.r_regionkey""",
    "x_products": """
        select p_partkey product_id,
               case when p_partkey % 40 = 0 then null else p_brand end product_category_name,
               p_size product_weight_g
        from part""",
    "x_translation": """
        select distinct p_brand product_category_name,
               lower(replace(p_brand, '#', '_')) product_category_name_english
        from part where p_brand not in ('Brand#5', 'Brand#15')""",
    "x_orders": """
        select o_orderkey order_id, o_orderkey customer_id,
               case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped' else 'canceled' end order_status,
               o_orderdate order_purchase_timestamp,
               case when o_orderkey % 50 <> 0 then o_orderdate + interval '1' hour end order_approved_at,
               case when o_orderstatus = 'F' and o_orderkey % 100 <> 0
                    then o_orderdate + interval '1' hour * cast((o_orderkey * 7) % 700 as int)
               end order_delivered_customer_date,
               o_orderdate + interval '1' day * cast((o_orderkey * 13) % 60 as int) order_estimated_delivery_date
        from orders""",
    "x_items": """
        select l_orderkey order_id, l_linenumber order_item_id, l_partkey product_id, l_suppkey seller_id,
               l_shipdate shipping_limit_date, cast(l_extendedprice as decimal(10,2)) price,
               cast(l_quantity as decimal(10,2)) freight_value
        from lineitem""",
    "x_payments": """
        select o_orderkey order_id, s.seq payment_sequential,
               case o_orderpriority when '1-URGENT' then 'credit_card' when '2-HIGH' then 'boleto'
                 when '3-MEDIUM' then 'voucher' when '5-LOW' then 'debit_card' else 'not_defined' end payment_type,
               cast(o_totalprice as decimal(10,2)) payment_value
        from orders join (values (1), (2), (3)) s(seq) on s.seq <= 1 + o_orderkey % 3""",
    "x_reviews": """
        select e.event_id review_id, o.o_orderkey order_id,
               cast(1 + (e.event_id * 3 + o.o_orderkey) % 5 as int) review_score,
               o.o_orderdate + interval '1' hour * cast((e.event_id * 11) % 900 as int) review_creation_date
        from events e join orders o on o.o_orderkey = e.event_id - e.event_id % 2""",
    "x_geo": """
        select lpad(cast(c_custkey % 97 as varchar), 5, '0') zip, c_acctbal lat,
               case when c_custkey % 10 <> 0 then -c_acctbal / 2 end lng, n_name city,
               case when c_custkey % 3 <> 0 then c_mktsegment end state
        from customer join nation on c_nationkey = n_nationkey""",
    "x_categories": """
        select p.product_id, p.product_category_name raw_name, t.product_category_name_english english_name,
               coalesce(t.product_category_name_english, p.product_category_name) best_name
        from x_products p left join x_translation t on t.product_category_name = p.product_category_name""",
    "x_lines": """
        select i.order_id, i.seller_id, i.product_id, i.price + i.freight_value amount,
               c.raw_name, c.english_name, c.best_name
        from x_items i join x_categories c on c.product_id = i.product_id""",
    "x_buyers": """
        select o.order_id, o.order_status, o.order_purchase_timestamp placed,
               o.order_delivered_customer_date arrived, o.order_estimated_delivery_date promised,
               c.customer_id, c.customer_unique_id person, c.customer_city city, c.customer_state state
        from x_orders o join x_customers c on c.customer_id = o.customer_id""",
    "x_delivered": """
        select order_id, order_delivered_customer_date arrived, order_estimated_delivery_date promised,
               order_delivered_customer_date > order_estimated_delivery_date late, order_purchase_timestamp placed
        from x_orders
        where order_status = 'delivered' and order_delivered_customer_date is not null
          and order_estimated_delivery_date is not null""",
    "x_order_value": "select order_id, sum(price + freight_value) total, count(*) n_items from x_items group by 1",
}


def needed(body: str, views: dict[str, str]) -> list[str]:
    """Views named in ``body``, each after the ones it is built from."""
    found: list[str] = []
    for name in re.findall(r"\bx_\w+", body):
        if name in views and name not in found:
            found += [n for n in needed(views[name], views) if n not in found] + [name]
    return list(dict.fromkeys(found))


def statement(body: str, views: dict[str, str] = VIEWS) -> str:
    names = needed(body, views)
    body = body.strip()
    if not names:
        return f"with {body[1:]}" if body.startswith(",") else body
    ctes = ",\n".join(f"{name} as ({views[name]})" for name in names)
    return f"with {ctes}\n{body}"
