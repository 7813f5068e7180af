"""SQL fragments of the same bindings, assembled into the check statements."""

from __future__ import annotations

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "raw": ("""select event_id, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) as k,
        date_trunc('millisecond', ts) as t, case when event_id % 10 <> 0 then cast(user_id as varchar) end as s,
        (event_id * 7) % 2100 as pid from events""", ()),
    "search": ("""select event_id, 'q' || (k % 20) as q, s, t,
        case when k % 7 <> 0 then cast(floor(value) as bigint) % 5 end as delivered,
        case when k % 7 <> 0 then cast(floor(value) as bigint) % 5 = 0 end as zero,
        case when k % 7 <> 0 then [ 'Item ' || ((event_id + i) % 2100) for i in range(1, cast(floor(value) as bigint) % 5 + 1)] else [] end as names
        from raw where event_type = 'view'""", ("raw",)),
    "tagged": ("""select *, case when k % 3 = 0 then 'q' || (k % 20) else '' end as q,
        case event_id % 5 when 0 then '' || pid when 1 then 'gid://shop/Product/' || pid when 2 then 'woo_product_' || pid when 3 then '---' else '' end as product_id,
        case when event_id % 5 = 4 then ' ITEM  ' || pid else '' end as product_name,
        case when event_id % 5 = 3 then 'https://shop.example/products/item-' || pid || '?ref=x' else '' end as product_url from raw""", ("raw",)),
    "click": ("select * from tagged where event_type = 'click'", ("tagged",)),
    "cart": ("select * from tagged where event_type = 'signup' and event_id % 17 <> 0", ("tagged",)),
    "checkout": ("select * from tagged where event_type = 'error'", ("tagged",)),
    "purchase": ("""select event_id, q, s, t, case when event_id % 4 < 2 then cast(event_id // 2 as varchar) end as order_id,
        value as total, case when user_id % 5 = 0 or user_id % 7 = 0 then null when user_id % 2 = 0 then 'ILS' else 'USD' end as currency
        from tagged where event_type = 'purchase' and (event_id % 6 <> 0 or event_id % 12 = 0)""", ("tagged",)),
    "orders_": ("""select * from (select *, row_number() over (partition by coalesce(order_id, 'x' || event_id) order by t, event_id) as rn,
        count(*) over (partition by coalesce(order_id, 'x' || event_id)) as copies from purchase) where rn = 1""", ("purchase",)),
    "stage": ("""select 'click' as kind, event_id, q, s, t, null as total, null as currency, 30 as w from click
        union all select 'cart', event_id, q, s, t, null, null, 120 from cart
        union all select 'checkout', event_id, q, s, t, null, null, 1440 from checkout
        union all select 'purchase', event_id, q, s, t, total, currency, 1440 from orders_""",
              ("click", "cart", "checkout", "orders_")),
    "hits": ("""select e.kind, e.event_id, arg_max(x.q, (x.t, -x.event_id)) as hit_q, max(x.t) as hit_t
        from stage e join search x on e.s = x.s and x.t <= e.t and x.t >= e.t - to_minutes(e.w) group by all""",
             ("stage", "search")),
    "attr": ("""select e.*, case when e.q <> '' then e.q else h.hit_q end as aq,
        case when e.q <> '' then 'explicit' when h.hit_q is not null then 'inferred' end as how,
        exists (select 1 from search x where x.s = e.s and x.q = case when e.q <> '' then e.q else h.hit_q end
                and x.t <= e.t and x.t >= e.t - to_minutes(e.w)) as searched
        from stage e left join hits h on h.kind = e.kind and h.event_id = e.event_id""", ("stage", "hits", "search")),
    "per_stage": ("""select aq as query, count(*) filter (kind = 'click') as clicks, count(*) filter (kind = 'cart') as carts,
        count(*) filter (kind = 'checkout') as checkouts, count(*) filter (kind = 'purchase') as purchases,
        count(*) filter (kind = 'purchase' and how = 'explicit') as explicit_purchases,
        count(distinct s) filter (kind = 'click' and searched) as click_sessions,
        count(distinct s) filter (kind = 'cart' and searched) as cart_sessions,
        count(distinct s) filter (kind = 'checkout' and searched) as checkout_sessions,
        count(distinct s) filter (kind = 'purchase' and searched) as purchase_sessions
        from attr where aq is not null group by 1""", ("attr",)),
    "per_search": ("""select q as query, count(*) as searches, count(distinct s) as search_sessions,
        count(*) filter (s is null) as missing_session, count(*) filter (zero) as zero_searches, count(zero) as measured_searches,
        arg_max(names[1:6], (t, -event_id)) filter (len(names) > 0) as delivered from search group by 1""", ("search",)),
    "funnel": ("""select query, coalesce(searches, 0) as searches, coalesce(search_sessions, 0) as search_sessions,
        coalesce(missing_session, 0) as missing_session, coalesce(zero_searches, 0) as zero_searches,
        coalesce(measured_searches, 0) as measured_searches, coalesce(clicks, 0) as clicks, coalesce(carts, 0) as carts,
        coalesce(checkouts, 0) as checkouts, coalesce(purchases, 0) as purchases,
        coalesce(explicit_purchases, 0) as explicit_purchases,
        coalesce(purchases, 0) - coalesce(explicit_purchases, 0) as inferred_purchases,
        coalesce(click_sessions, 0) as click_sessions, coalesce(cart_sessions, 0) as cart_sessions,
        coalesce(checkout_sessions, 0) as checkout_sessions, coalesce(purchase_sessions, 0) as purchase_sessions,
        zero_searches / nullif(measured_searches, 0) as zero_rate,
        coalesce(click_sessions, 0) / nullif(search_sessions, 0) as click_rate,
        coalesce(cart_sessions, 0) / nullif(search_sessions, 0) as cart_rate,
        coalesce(purchase_sessions, 0) / nullif(search_sessions, 0) as purchase_rate,
        coalesce(delivered, []) as delivered
        from per_search full join per_stage using (query)
        where coalesce(searches, 0) > 0 or coalesce(clicks, 0) > 0 or coalesce(carts, 0) > 0 or coalesce(purchases, 0) > 0""",
               ("per_search", "per_stage")),
    "store": ("""select (select count(distinct s) from (select s from search union all select s from stage)) as sessions,
        (select count(distinct s) from search) as searched,
        count(distinct s) filter (kind = 'click') as clicked, count(distinct s) filter (kind = 'cart') as carted,
        count(distinct s) filter (kind = 'checkout') as checkout, count(distinct s) filter (kind = 'purchase') as purchased
        from stage join hits using (kind, event_id)""", ("stage", "hits", "search")),
    "store_rates": ("""select *, clicked / nullif(searched, 0) as click_rate, carted / nullif(searched, 0) as cart_rate,
        checkout / nullif(searched, 0) as checkout_rate, purchased / nullif(searched, 0) as purchase_rate from store""", ("store",)),
    "classified": ("""select f.*, case when coalesce(f.zero_rate, 0) >= 0.5 and f.searches >= 3 then 'zero_results'
          when f.search_sessions < 5 or f.click_rate is null then 'unmeasured'
          when f.click_rate < r.click_rate * 0.5 then 'no_click'
          when r.click_rate > 0 and f.click_rate > 0 and coalesce(f.cart_rate, 0) / f.click_rate < r.cart_rate / r.click_rate * 0.5 then 'click_no_cart'
          when r.cart_rate > 0 and f.purchase_rate is not null and coalesce(f.cart_rate, 0) > 0
               and f.purchase_rate / f.cart_rate < r.purchase_rate / r.cart_rate * 0.5 then 'cart_no_purchase'
          else 'healthy' end as leak_stage,
        floor(coalesce(case when r.purchase_rate > 0 then greatest(0, (r.purchase_rate - f.purchase_rate) * f.search_sessions)
          when r.cart_rate > 0 then greatest(0, (r.cart_rate - f.cart_rate) * f.search_sessions)
          else greatest(0, (r.click_rate - f.click_rate) * f.search_sessions) end, 0) * 10 + 0.5) / 10 as sessions_below_average
        from funnel f, store_rates r""", ("funnel", "store_rates")),
    "product": ("""select '' || p_partkey as id, 'Item ' || p_partkey as name, p_partkey,
        array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as title,
        'A ' || p_name || ' of type ' || lower(p_type) || ', size ' || p_size as description,
        'https://shop.example/products/item-' || p_partkey as url, 'SKU-' || p_partkey as sku, p_brand as brand,
        p_retailprice as price, case when p_partkey % 4 = 0 then p_retailprice * 1.25 else p_retailprice end as regular_price,
        case when p_size % 7 = 0 then 'outofstock' when p_size % 13 = 0 then 'onbackorder' else 'instock' end as stock_status,
        p_size % 11 = 0 as hidden, case when p_partkey % 9 = 0 then 'draft' else 'ACTIVE' end as status,
        [p_type, string_split(p_name, ' ')[-1]] as categories, p_name, p_type, p_size as size,
        list_filter([p_brand, case when p_size > 40 then 'large' end, case when p_size < 10 then 'small' end], lambda x: x is not null) as tags,
        string_split(p_name, ' ')[1] as color, cast(p_partkey % 50 as double) as popularity from part""", ()),
    # event -> product by any of its keys; the shop's ids are the part keys themselves
    "chosen_raw": ("""select a.aq as query, a.kind, a.event_id, case when c.product_id <> '' then c.product_id else c.product_name end as key,
        c.product_id as pid, c.product_name as name, c.product_url as url, c.pid as target
        from attr a join tagged c on c.event_id = a.event_id where a.aq is not null and a.kind in ('click', 'cart')
        union all select a.aq, 'purchase', a.event_id, '' || ((a.event_id * 7 + i * 13) % 2100), '' || ((a.event_id * 7 + i * 13) % 2100),
        'Item ' || ((a.event_id * 7 + i * 13) % 2100), '', (a.event_id * 7 + i * 13) % 2100
        from attr a, (select unnest([0, 1, 2]) as i) x
        where a.aq is not null and a.kind = 'purchase' and x.i <= a.event_id % 3""", ("attr", "tagged")),
}


def sql(body: str, *needs: str) -> str:
    """``body`` preceded by the named fragments and everything they depend on."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in CTES[name][1]:
                visit(dep)
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return body
    head = ",\n".join(f"{n} as ({CTES[n][0]})" for n in order)
    return f"with {head}\n{body}"
