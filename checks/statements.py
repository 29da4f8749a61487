"""One DuckDB statement per registered report."""

from __future__ import annotations

from checks.fixed import BATCH_UNTIL, RANGE_FROM, RANGE_UNTIL, SELECTED_BRANCH, VIEW_TOTALS, WANTED
from checks.oracle import growth, mean_money, money, percent, ratio, statement
from countinghouse.schemas import TABLES

BIG = "CAST({} AS BIGINT)".format
TWO = "CAST(round({}, 2) AS DOUBLE)".format

# Columns of each table that hold cents, or hundredths of a gram.
_SCALED = {
    "employees": ["monthly_target"],
    "products": ["weight_grams", "making_charge", "cost_price", "selling_price"],
    "sales": ["discount_amount"],
    "sale_items": ["unit_price"],
    "gold_prices": ["price_per_gram"],
}


def _all_columns(name: str, source: str, where: str = "") -> str:
    scaled = _SCALED.get(name, [])
    swap = ", ".join(f"{money(c)} AS {c}" for c in scaled)
    star = f"* REPLACE ({swap})" if swap else "*"
    return f"SELECT {star} FROM {source} {where}"


def _mix(source: str, key: str, name: str, rows: str, share: str) -> str:
    everything = f"(SELECT count(*) FROM {source})"
    return f"""
        SELECT {key} AS {name}, count(*) AS {rows}, {percent("count(*)", everything)} AS {share}
        FROM {source} GROUP BY 1"""


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _broken(rules: list[tuple[str, str, str]]) -> str:
    return _union(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name,"
            f" count(*) FILTER (WHERE {p}) AS violations FROM {src}"
            for t, c, p, src in ((t, c, p, f"bad_{t}") for t, c, p in rules)
        ]
    )


def _repeats(keys: list[tuple[str, tuple[str, ...]]]) -> str:
    return _union(
        [
            f"SELECT '{t}' AS table_name, '{','.join(k)}' AS key_columns,"
            f" count(*) AS repeated_keys, {BIG('coalesce(sum(n), 0)')} AS rows_involved"
            f" FROM (SELECT count(*) AS n FROM bad_{t}"
            f" WHERE {' AND '.join(f'{c} IS NOT NULL' for c in k)}"
            f" GROUP BY {', '.join(k)} HAVING count(*) > 1)"
            for t, k in keys
        ]
    )


TX_SUMS = f"""count(*) AS transaction_count, {BIG("sum(units)")} AS units_sold,
    {money("sum(gross)")} AS gross_revenue, {money("sum(discount_amount)")} AS total_discounts,
    {money("sum(net)")} AS net_revenue, {money("sum(profit)")} AS estimated_net_profit"""
ATV = f"{mean_money('sum(net)', 'count(*)')} AS average_transaction_value"

SPLIT_SUMS = f"""count(DISTINCT sale_id) AS transaction_count, {BIG("sum(q)")} AS units_sold,
    {money("sum(rev)")} AS gross_revenue, {TWO("sum(cut)")} AS allocated_discounts,
    {TWO("CAST(sum(rev) FILTER (WHERE cut IS NOT NULL) AS DECIMAL(38, 12)) / 100 - sum(cut)")}
        AS net_revenue,
    {TWO("CAST(sum(gain) FILTER (WHERE cut IS NOT NULL) AS DECIMAL(38, 12)) / 100 - sum(cut)")}
        AS estimated_net_profit"""

STAFF_COLUMNS = f"""employee_id, employee_name, job_title, branch_name, n AS transaction_count,
    {BIG("units")} AS units_sold, {money("net")} AS net_revenue,
    coalesce({mean_money("net", "n")}, 0) AS average_transaction_value,
    {money("profit")} AS estimated_net_profit"""

RFM_COLUMNS = f"""customer_id, customer_name, city, CAST(recency AS INT) AS recency_days, frequency,
    {money("spent")} AS monetary_value, CAST(r AS INT) AS recency_score,
    CAST(f AS INT) AS frequency_score, CAST(m AS INT) AS monetary_score"""

EXEC = f"""n AS total_transactions, n_buyers AS registered_customers,
    n_branches AS active_branches, {BIG("units")} AS total_units_sold,
    {money("gross")} AS gross_revenue, {money("discounts")} AS total_discounts,
    {money("net")} AS net_revenue, {mean_money("net", "n")} AS average_transaction_value,
    {money("profit")} AS estimated_net_profit"""

CUSTOMER = f"""customer_id, customer_name, city, n AS purchase_count,
    first_on AS first_purchase_date, last_on AS last_purchase_date,
    {money("spent")} AS total_spent, coalesce({mean_money("spent", "n")}, 0)
    AS average_transaction_value"""

PRODUCT = f"""product_id, product_name, category, gold_type_name, n_sales AS transaction_count,
    {BIG("units")} AS units_sold, {money("gross")} AS gross_revenue,
    {money("gain")} AS estimated_profit_before_discount"""

BRANCH = f"""branch_id, branch_name, city, n AS transaction_count,
    n_buyers AS registered_customers, {BIG("coalesce(units, 0)")} AS units_sold,
    {money("coalesce(net, 0)")} AS net_revenue,
    coalesce({mean_money("net", "n")}, 0) AS average_transaction_value,
    {money("coalesce(profit, 0)")} AS estimated_net_profit"""

STOCK = f"""inventory_id, branch_id, branch_name, product_id, product_name, category,
    stock_quantity, reorder_level, last_updated, status AS inventory_status,
    {money("cost")} AS inventory_cost_value, {money("retail")} AS inventory_retail_value"""

MONTH = f"""sales_month, n AS transaction_count, n_buyers AS registered_customers,
    {BIG("units")} AS units_sold, {money("gross")} AS gross_revenue,
    {money("discounts")} AS total_discounts, {money("net")} AS net_revenue,
    {money("profit")} AS estimated_net_profit,
    {mean_money("net", "n")} AS average_transaction_value"""


def _before(parent: str, key: str, date: str) -> str:
    return f"""SELECT sale_id, {key}, sale_date, {date} FROM raw_sales
               JOIN (SELECT {key}, {date} FROM raw_{parent}) USING ({key})
               WHERE CAST(sale_date AS DATE) < {date}"""


def _views() -> dict[str, str]:
    return {
        "monthly_sales_summary": f"SELECT {MONTH} FROM month_view",
        "branch_performance": f"SELECT {BRANCH} FROM branch_view",
        "product_performance": f"SELECT {PRODUCT} FROM product_view",
        "customer_summary": f"SELECT {CUSTOMER} FROM customer_view",
        "inventory_risk": f"SELECT {STOCK} FROM stock_view",
        "employee_performance": f"SELECT {STAFF_COLUMNS}, branch_id,"
        f" {money('monthly_target')} AS monthly_target FROM staff_view",
        "customer_segments": f"SELECT {RFM_COLUMNS}, customer_segment"
        " FROM segments JOIN named USING (customer_id)",
        "executive_summary": f"SELECT {EXEC} FROM exec_view",
    }


def _statements() -> dict[str, str]:
    views = _views()
    months_lag = "lag({}) OVER (ORDER BY sales_month)".format
    q: dict[str, str] = {}

    # shared measures
    q["m_transaction_totals"] = f"""
        SELECT sale_id, {BIG("units")} AS units_sold, {money("gross")} AS gross_revenue,
               {money("profit + discount_amount")} AS profit_before_discount FROM tx"""
    q["m_sale_net_revenue"] = f"SELECT sale_id, {money('net')} AS net_revenue FROM nx"
    q["m_employee_net"] = f"""
        SELECT sale_id, employee_id, {BIG("units")} AS units_sold, {money("net")} AS net_revenue,
               {money("profit")} AS estimated_net_profit FROM tx"""
    q["m_discount_allocation"] = f"""
        SELECT sale_id, product_id, {BIG("sum(q)")} AS quantity,
               {money("sum(rev)")} AS line_revenue, {TWO("sum(cut)")} AS allocated_discount
        FROM split GROUP BY ALL"""
    q["m_reference_date"] = """
        SELECT today AS analysis_date, CAST(today + 1 AS DATE) AS day_after FROM today"""
    q["m_inventory_status"] = "SELECT inventory_id, status AS inventory_status FROM stock_view"
    q["m_pct_change"] = f"""
        SELECT sales_month, {growth("net", months_lag("net"))} AS change_percentage FROM months"""
    q["m_share_of_total"] = _mix(
        "sale_items", "quantity", "quantity", "line_count", "line_percentage"
    )

    # sources and layers
    q["io_csv_scan"] = """
        SELECT supplier_id, supplier_name, city, nullif(phone, '') AS phone FROM raw_suppliers"""
    q["io_csv_rejects"] = f"""
        SELECT CASE sale_id % 70 WHEN 3 THEN 'bad value: quantity' WHEN 4 THEN 'missing fields'
                    WHEN 5 THEN 'surplus fields' ELSE 'accepted' END AS reason, count(*) AS lines,
               {BIG("sum(CASE WHEN sale_id % 70 IN (3, 4, 5) THEN 0 ELSE quantity END)")} AS units
        FROM raw_sale_items GROUP BY 1"""
    q["io_insert_ignore"] = """
        SELECT branch_id, branch_name, city, opening_date FROM raw_branches
        WHERE branch_id % 2 = 0
        UNION ALL SELECT branch_id, upper(branch_name), city, opening_date FROM raw_branches
        WHERE branch_id % 2 = 1"""
    q["io_views"] = _union(
        [
            f"SELECT '{n}' AS view_name, count(*) AS row_count,"
            f" CAST(sum(CAST({VIEW_TOTALS[n]} AS DECIMAL(38,2))) AS DOUBLE) AS total FROM ({v})"
            for n, v in views.items()
        ]
    )
    q["io_query_to_frame"] = f"""
        SELECT city, count(*) AS branches, {money("sum(coalesce(net, 0))")} AS net_revenue
        FROM branch_view GROUP BY city"""

    # constraints, over the tables with broken rows
    q["k_not_null"] = _broken(
        [(t, c, f"{c} IS NULL") for t, spec in TABLES.items() for c in spec.required]
    )
    q["k_primary_key"] = _repeats([(t, spec.key) for t, spec in TABLES.items()])
    q["k_unique"] = _repeats([(t, k) for t, spec in TABLES.items() for k in spec.unique])
    q["k_check"] = _broken(
        [(t, c, f"NOT ({p})") for t, spec in TABLES.items() for c, p in spec.checks.items()]
    )
    q["k_foreign_key"] = _union(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{parent}' AS parent_table,"
            f" count(*) AS violations FROM bad_{t} WHERE {c} NOT IN"
            f" (SELECT {TABLES[parent].key[0]} FROM bad_{parent})"
            for t, spec in TABLES.items()
            for c, parent in spec.parents.items()
        ]
    )
    q["k_default"] = "SELECT sale_id, CAST(0 AS DOUBLE) AS discount_amount FROM raw_sales"
    limits = [
        (t, c, f"length({c}) > {n}")
        for t, spec in TABLES.items()
        for c, n in spec.text_limits.items()
    ]
    wide = {"selling_price": "product_id % 50 = 13 AND selling_price >= 1000000"}
    limits += [
        (t, c, wide.get(c, "false"))
        for t, spec in TABLES.items()
        for c, kind in spec.columns.items()
        if kind.startswith("decimal")
    ]
    q["k_type_limits"] = _broken(limits)
    q["k_not_future"] = (
        "SELECT branch_id, branch_name, city, opening_date FROM bad_branches"
        " WHERE opening_date > DATE '2001-08-01'"
    )

    # data quality
    q["dq_row_counts"] = _union(
        [f"SELECT '{t}' AS table_name, count(*) AS row_count FROM raw_{t}" for t in TABLES]
    )
    q["dq_missing_customers"] = """
        SELECT count(*) AS total_customers, count(*) - count(customer_name) AS missing_names,
               count(*) - count(phone) AS missing_phones, count(*) - count(city) AS missing_cities,
               count(*) - count(registration_date) AS missing_registration_dates
        FROM raw_customers"""
    q["dq_missing_suppliers"] = """
        SELECT count(*) AS total_suppliers, count(*) - count(supplier_name) AS missing_names,
               count(*) - count(phone) AS missing_phones, count(*) - count(city) AS missing_cities
        FROM raw_suppliers"""
    q["dq_walk_in_sales"] = """
        SELECT count(*) AS total_sales, count(*) - count(customer_id) AS walk_in_sales
        FROM raw_sales"""
    q["dq_duplicate_customers"] = """
        SELECT * FROM (SELECT customer_name, phone, count(*) AS duplicate_count
                       FROM raw_customers GROUP BY ALL) WHERE duplicate_count > 1"""
    q["dq_duplicate_sale_items"] = """
        SELECT * FROM (SELECT sale_id, product_id, count(*) AS duplicate_count
                       FROM raw_sale_items GROUP BY ALL) WHERE duplicate_count > 1"""
    q["dq_invalid_products"] = _all_columns(
        "products", "bad_products",
        "WHERE weight_grams <= 0 OR making_charge < 0 OR cost_price <= 0 OR selling_price <= 0",
    )
    q["dq_invalid_sale_items"] = _all_columns(
        "sale_items", "bad_sale_items", "WHERE quantity <= 0 OR unit_price <= 0"
    )
    q["dq_invalid_inventory"] = _all_columns(
        "inventory", "bad_inventory", "WHERE stock_quantity < 0 OR reorder_level < 0"
    )
    q["dq_invalid_discounts"] = _all_columns("sales", "bad_sales", "WHERE discount_amount < 0")
    q["dq_invalid_gold_prices"] = _all_columns(
        "gold_prices", "bad_gold_prices", "WHERE price_per_gram <= 0"
    )
    q["dq_orphan_sales_customer"] = _all_columns(
        "sales", "bad_sales", "WHERE customer_id NOT IN (SELECT customer_id FROM bad_customers)"
    )
    q["dq_orphan_sales_employee"] = _all_columns(
        "sales", "bad_sales",
        "AS x WHERE NOT EXISTS (FROM bad_employees AS y WHERE y.employee_id = x.employee_id)",
    )
    q["dq_orphan_sale_items"] = _all_columns(
        "sale_items", "bad_sale_items",
        "WHERE sale_id NOT IN (SELECT sale_id FROM bad_sales)"
        " OR product_id NOT IN (SELECT product_id FROM bad_products)",
    )
    q["dq_sale_before_registration"] = _before("customers", "customer_id", "registration_date")
    q["dq_sale_before_hire"] = _before("employees", "employee_id", "hire_date")
    q["dq_sale_before_opening"] = _before("branches", "branch_id", "opening_date")
    q["dq_branch_mismatch"] = """
        SELECT count(*) AS mismatched_branch_sales
        FROM raw_sales AS x JOIN raw_employees AS y USING (employee_id)
        WHERE x.branch_id <> y.branch_id"""

    # cleaning
    for name in TABLES:
        q[f"clean_{name}"] = _all_columns(name, name)
    q["clean_quarantine"] = _union(
        [
            f"SELECT '{t}' AS table_name, outcome, count(*) AS row_count FROM"
            " (SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['valid']"
            f" ELSE list_append(reasons, 'rejected') END) AS outcome FROM judged_{t})"
            " GROUP BY outcome"
            for t in TABLES
        ]
    )

    # exploration
    q["eda_overview"] = """
        SELECT count(*) AS total_transactions, count(DISTINCT customer_id) AS registered_customers,
               count(DISTINCT employee_id) AS active_employees,
               count(DISTINCT branch_id) AS active_branches FROM sales"""
    q["eda_date_range"] = """
        SELECT min(sale_date) AS first_sale_date, max(sale_date) AS latest_sale_date,
               CAST(date_diff('day', CAST(min(sale_date) AS DATE), CAST(max(sale_date) AS DATE))
                    AS INT) AS total_days FROM sales"""
    q["eda_category_overview"] = f"""
        SELECT category, count(*) AS product_count,
               {mean_money("sum(weight_grams)", "count(*)")} AS average_weight_grams,
               {mean_money("sum(selling_price)", "count(*)")} AS average_selling_price
        FROM products GROUP BY category"""
    q["eda_payment_mix"] = _mix(
        "sales", "payment_method", "payment_method", "transaction_count", "transaction_percentage"
    )
    q["eda_branch_overview"] = """
        SELECT branches.branch_id, branch_name, city, count(sale_id) AS transaction_count,
               count(DISTINCT customer_id) AS registered_customers
        FROM branches LEFT JOIN sales USING (branch_id) GROUP BY ALL"""
    q["eda_customer_type"] = _mix(
        "sales", "if(customer_id IS NULL, 'Walk-in Customer', 'Registered Customer')",
        "customer_type", "transaction_count", "transaction_percentage",
    )
    q["eda_customer_city"] = _mix(
        "named", "city", "city", "customer_count", "customer_percentage"
    )
    q["eda_quantity_overview"] = f"""
        SELECT count(*) AS total_sale_items, {BIG("sum(quantity)")} AS total_units_sold,
               {ratio("sum(quantity)", "count(*)")} AS average_quantity_per_item,
               min(quantity) AS minimum_quantity, max(quantity) AS maximum_quantity
        FROM sale_items"""
    q["eda_margins"] = f"""
        SELECT category, count(*) AS product_count,
               {mean_money("sum(cost_price)", "count(*)")} AS average_cost_price,
               {mean_money("sum(selling_price)", "count(*)")} AS average_selling_price,
               {mean_money("sum(selling_price - cost_price)", "count(*)")}
                   AS average_estimated_profit,
               round(avg(100 * CAST(selling_price - cost_price AS DOUBLE)
                         / nullif(selling_price, 0)), 2) AS average_profit_margin_percentage
        FROM products GROUP BY category"""
    q["eda_inventory_status"] = f"""
        SELECT status AS inventory_status, count(*) AS inventory_record_count,
               {BIG("sum(stock_quantity)")} AS total_units FROM stock_view GROUP BY status"""
    q["eda_gold_prices"] = f"""
        SELECT gold_type_name, {money("min(price_per_gram)")} AS minimum_price_per_gram,
               {money("max(price_per_gram)")} AS maximum_price_per_gram,
               {mean_money("sum(price_per_gram)", "count(*)")} AS average_price_per_gram
        FROM gold_prices JOIN gold_types USING (gold_type_id) GROUP BY gold_type_name"""
    q["eda_monthly_trend"] = """
        SELECT sales_month, count(*) AS transaction_count,
               count(DISTINCT customer_id) AS registered_customers
        FROM heads GROUP BY sales_month"""
    q["eda_category_units"] = f"""
        SELECT category, count(DISTINCT sale_id) AS transactions, {BIG("sum(q)")} AS units_sold
        FROM lines GROUP BY category"""
    q["eda_supplier_products"] = """
        SELECT suppliers.supplier_id, supplier_name, count(product_id) AS products_supplied
        FROM suppliers LEFT JOIN products USING (supplier_id) GROUP BY ALL"""

    # sales
    q["sales_kpis"] = f"""
        SELECT n AS total_transactions, {BIG("units")} AS total_units_sold,
               {money("gross")} AS gross_revenue, {money("discounts")} AS total_discounts,
               {money("net")} AS net_revenue, {mean_money("net", "n")} AS average_transaction_value,
               {money("profit")} AS estimated_net_profit FROM exec_view"""
    q["sales_monthly"] = f"SELECT sales_month, {TX_SUMS} FROM tx GROUP BY sales_month"
    q["sales_mom_growth"] = f"""
        SELECT sales_month, {money("net")} AS net_revenue,
               {money(months_lag("net"))} AS previous_month_revenue,
               {growth("net", months_lag("net"))} AS monthly_growth_percentage FROM months"""
    q["sales_by_category"] = f"SELECT category, {SPLIT_SUMS} FROM split GROUP BY category"
    q["sales_by_payment"] = f"""
        SELECT payment_method, {TX_SUMS}, {ATV} FROM tx GROUP BY payment_method"""
    q["sales_top_products"] = f"""
        SELECT * EXCLUDE (gross_revenue, allocated_discounts)
        FROM (SELECT product_id, product_name, category, {SPLIT_SUMS} FROM split GROUP BY ALL)
        ORDER BY net_revenue DESC, product_id LIMIT 20"""
    q["sales_by_weekday"] = f"""
        SELECT CAST(dayofweek(sold_on) AS INT) AS day_number, dayname(sold_on) AS day_name,
               count(*) AS transaction_count, {money("sum(net)")} AS net_revenue, {ATV}
        FROM nx GROUP BY 1, 2"""
    q["sales_discounted_vs_not"] = f"""
        SELECT if(discount_amount > 0, 'Discounted', 'No Discount') AS discount_status,
               count(*) AS transaction_count, {money("sum(gross)")} AS gross_revenue,
               {money("sum(discount_amount)")} AS total_discounts,
               {money("sum(net)")} AS net_revenue, {ATV}
        FROM nx GROUP BY 1"""

    # customers
    q["cust_kpis"] = f"""
        SELECT count(*) AS customers_with_purchases, count(*) FILTER (n = 1) AS one_time_customers,
               count(*) FILTER (n > 1) AS repeat_customers,
               {percent("count(*) FILTER (n > 1)", "count(*)")} AS repeat_customer_percentage,
               {mean_money("sum(spent)", "count(*)")} AS average_customer_value,
               {money("sum(spent)")} AS registered_customer_revenue FROM buyers"""
    buyer = f"""customer_id, customer_name, city, n AS purchase_count,
        last_on AS last_purchase_date, {money("spent")} AS total_spent"""
    idle = "CAST(date_diff('day', last_on, today) AS INT)"
    q["cust_top20"] = f"""
        SELECT {buyer}, {idle} AS days_since_last_purchase,
               {mean_money("spent", "n")} AS average_transaction_value
        FROM buyers JOIN named USING (customer_id), today ORDER BY spent DESC, customer_id
        LIMIT 20"""
    q["cust_valuable_inactive"] = f"""
        SELECT {buyer}, {idle} AS days_inactive
        FROM buyers JOIN named USING (customer_id), today WHERE {idle} > 180
        ORDER BY spent DESC, customer_id LIMIT 20"""
    q["cust_frequency_groups"] = """
        SELECT CASE WHEN n = 1 THEN 'One-time Customer'
                    WHEN n BETWEEN 2 AND 5 THEN 'Occasional Customer'
                    WHEN n BETWEEN 6 AND 10 THEN 'Regular Customer'
                    ELSE 'Frequent Customer' END AS customer_group, count(*) AS customer_count
        FROM (SELECT count(*) AS n FROM sales WHERE customer_id IS NOT NULL GROUP BY customer_id)
        GROUP BY 1"""
    q["cust_city_revenue"] = f"""
        SELECT city, count(DISTINCT customer_id) AS purchasing_customers,
               count(*) AS transaction_count, {money("sum(net)")} AS net_revenue, {ATV}
        FROM nx JOIN named USING (customer_id) GROUP BY city"""
    q["cust_new_vs_returning"] = """
        SELECT sales_month, count(DISTINCT customer_id) FILTER (sales_month = first_month)
                   AS new_customers,
               count(DISTINCT customer_id) FILTER (sales_month > first_month)
                   AS returning_customers, count(DISTINCT customer_id) AS active_customers
        FROM heads JOIN (SELECT customer_id, min(sales_month) AS first_month FROM heads
                         WHERE customer_id IS NOT NULL GROUP BY customer_id) USING (customer_id)
        GROUP BY sales_month"""
    q["cust_rfm_scores"] = f"SELECT {RFM_COLUMNS} FROM rfm JOIN named USING (customer_id)"
    q["cust_rfm_segments"] = f"""
        SELECT customer_segment, count(*) AS customer_count,
               {percent("count(*)", "(SELECT count(*) FROM rfm)")} AS customer_percentage,
               {money("sum(spent)")} AS segment_revenue,
               {mean_money("sum(spent)", "count(*)")} AS average_customer_value
        FROM segments GROUP BY customer_segment"""

    # products and stock
    q["inv_kpis"] = f"""
        SELECT count(DISTINCT product_id) AS total_products,
               count(DISTINCT category) AS total_categories,
               {BIG("sum(stock_quantity)")} AS total_stock_units,
               count(*) FILTER (status = 'Out of Stock') AS out_of_stock_records,
               count(*) FILTER (status = 'Low Stock') AS low_stock_records,
               {money("sum(cost)")} AS estimated_inventory_cost_value,
               {money("sum(retail)")} AS estimated_inventory_retail_value FROM stock_view"""
    q["prod_by_category"] = f"""
        SELECT category, count(DISTINCT p.product_id) AS product_count,
               count(DISTINCT sale_id) AS transaction_count,
               {BIG("sum(quantity)")} AS units_sold,
               {money("sum(quantity::HUGEINT * unit_price)")} AS gross_revenue,
               {money("sum(quantity::HUGEINT * (unit_price - cost_price))")}
                   AS estimated_profit_before_discount,
               {mean_money("sum(selling_price)", "count(*)")} AS average_product_price
        FROM products AS p LEFT JOIN sale_items USING (product_id) GROUP BY category"""
    q["inv_low_stock"] = """
        SELECT branch_name, product_id, product_name, category, stock_quantity, reorder_level,
               status AS stock_status FROM stock_view WHERE status <> 'Healthy Stock'"""
    q["inv_value_by_branch"] = f"""
        SELECT branch_id, branch_name, city, {BIG("sum(stock_quantity)")} AS total_stock_units,
               {money("sum(cost)")} AS inventory_cost_value,
               {money("sum(retail)")} AS inventory_retail_value,
               {money("sum(retail - cost)")} AS potential_inventory_profit
        FROM stock_view JOIN (SELECT branch_id, city FROM branches) USING (branch_id)
        GROUP BY branch_id, branch_name, city"""
    q["prod_slow_moving"] = """
        SELECT product_id, product_name, category, total_units_sold, last_sale_date,
               days_since_last_sale, stock AS total_stock_quantity,
               if(last_sale_date IS NULL, 'Never Sold', 'Slow Moving') AS product_status
        FROM (SELECT product_id, product_name, category,
                     CAST(coalesce(sum(quantity), 0) AS BIGINT) AS total_units_sold,
                     max(sold_on) AS last_sale_date,
                     CAST(date_diff('day', max(sold_on), (SELECT today FROM today)) AS INT)
                         AS days_since_last_sale
              FROM products LEFT JOIN sale_items USING (product_id)
                   LEFT JOIN (SELECT sale_id, sold_on FROM heads) USING (sale_id)
              GROUP BY ALL) JOIN stock USING (product_id)
        WHERE last_sale_date IS NULL OR days_since_last_sale > 180"""
    q["prod_top20"] = f"""
        SELECT {PRODUCT} FROM product_view WHERE n_sales > 0
        ORDER BY gross DESC, product_id LIMIT 20"""
    q["inv_overstock"] = f"""
        SELECT product_id, product_name, category, stock AS total_stock_quantity,
               {BIG("units")} AS units_sold_last_90_days,
               {ratio("stock", "units")} AS stock_to_recent_sales_ratio,
               CASE WHEN units > 0 THEN 'Potential Overstock' WHEN stock > 0 THEN 'No Recent Sales'
                    ELSE 'Normal Stock' END AS inventory_risk
        FROM (SELECT product_id, product_name, category, stock,
                     coalesce((SELECT sum(quantity) FROM sale_items AS x
                               JOIN (SELECT sale_id, sold_on FROM heads) USING (sale_id), today
                               WHERE x.product_id = p.product_id
                                 AND date_diff('day', sold_on, today) < 90), 0) AS units
              FROM products AS p JOIN stock USING (product_id))
        WHERE units = 0 OR stock > 2 * units"""
    q["supplier_performance"] = f"""
        SELECT supplier_id, supplier_name, count(product_id) AS products_supplied,
               {BIG("coalesce(sum(units), 0)")} AS units_sold,
               {money("coalesce(sum(gross), 0)")} AS gross_revenue,
               {BIG("coalesce(sum(stock), 0)")} AS current_stock_units,
               {money("coalesce(sum(stock * cost_price), 0)")} AS inventory_cost_value
        FROM suppliers LEFT JOIN products USING (supplier_id) LEFT JOIN sold USING (product_id)
             LEFT JOIN stock USING (product_id)
        GROUP BY supplier_id, supplier_name"""

    # branches and employees
    q["branch_performance_detail"] = f"""
        SELECT branch_id, branch_name, city, n AS transaction_count,
               n_buyers AS registered_customers, {BIG("units")} AS units_sold,
               {money("gross")} AS gross_revenue, {money("discounts")} AS total_discounts,
               {money("net")} AS net_revenue, {mean_money("net", "n")} AS average_transaction_value,
               {money("profit")} AS estimated_net_profit FROM branch_view"""
    q["branch_rankings"] = f"""
        SELECT branch_id, branch_name, city, n AS transaction_count,
               {money("coalesce(net, 0)")} AS net_revenue,
               CAST(rank() OVER (ORDER BY coalesce(net, 0) DESC) AS INT) AS revenue_rank,
               CAST(rank() OVER (ORDER BY n DESC) AS INT) AS transaction_rank FROM branch_view"""
    q["employee_performance_detail"] = f"SELECT {STAFF_COLUMNS} FROM staff_view"
    q["employee_rankings"] = f"""
        SELECT employee_id, employee_name, job_title, branch_name, n AS transaction_count,
               {money("net")} AS net_revenue,
               CAST(rank() OVER (PARTITION BY branch_id ORDER BY net DESC) AS INT)
                   AS rank_within_branch,
               CAST(rank() OVER (ORDER BY net DESC) AS INT) AS overall_rank FROM staff_view"""
    q["employee_monthly_target"] = f"""
        SELECT employee_id, employee_name, branch_name, sales_month, n AS transaction_count,
               {money("monthly_target")} AS monthly_target, {money("net")} AS monthly_net_revenue,
               {percent("net", "monthly_target")} AS target_achievement_percentage,
               if(net < monthly_target, 'Below Target', 'Target Achieved') AS target_status
        FROM staff_months"""
    q["employee_target_summary"] = f"""
        SELECT employee_id, employee_name, branch_name, count(*) AS active_sales_months,
               count(*) FILTER (net >= monthly_target) AS months_target_achieved,
               {percent("count(*) FILTER (net >= monthly_target)", "count(*)")}
                   AS target_success_rate_percentage,
               round(avg(100 * CAST(net AS DOUBLE) / nullif(monthly_target, 0)), 2)
                   AS average_target_achievement_percentage
        FROM staff_months GROUP BY employee_id, employee_name, branch_name"""
    branch_lag = "lag(net) OVER (PARTITION BY branch_id ORDER BY sales_month)"
    q["branch_monthly_growth"] = f"""
        SELECT branch_name, sales_month, n AS transaction_count, {money("net")} AS net_revenue,
               {money(branch_lag)} AS previous_month_revenue,
               {growth("net", branch_lag)} AS monthly_growth_percentage
        FROM branch_months JOIN branches USING (branch_id)"""

    # advanced
    q["adv_cumulative_rolling"] = f"""
        SELECT sales_month, {money("net")} AS monthly_net_revenue,
               {money("sum(net) OVER (ORDER BY sales_month)")} AS cumulative_net_revenue,
               {mean_money("sum(net) OVER w", "count(*) OVER w")} AS three_month_rolling_average
        FROM months
        WINDOW w AS (ORDER BY sales_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
    q["adv_product_rank"] = f"""
        SELECT product_id, product_name, category, {BIG("units")} AS units_sold,
               {money("gross")} AS gross_revenue,
               CAST(dense_rank() OVER (PARTITION BY category ORDER BY gross DESC) AS INT)
                   AS revenue_rank_within_category,
               {percent("gross", "sum(gross) OVER (PARTITION BY category)")}
                   AS category_revenue_percentage
        FROM products JOIN sold USING (product_id)"""
    running = "sum(gross) OVER (ORDER BY gross DESC, product_id ROWS UNBOUNDED PRECEDING)"
    q["adv_pareto"] = f"""
        SELECT product_id, product_name, category, {money("gross")} AS gross_revenue,
               {percent("gross", "total")} AS revenue_contribution_percentage,
               {percent("upto", "total")} AS cumulative_revenue_percentage,
               if(5 * upto <= 4 * total, 'Top Revenue Contributors', 'Remaining Products')
                   AS pareto_group
        FROM (SELECT *, {running} AS upto, sum(gross) OVER () AS total
              FROM products JOIN sold USING (product_id))"""
    q["adv_branch_share"] = f"""
        SELECT sales_month, branch_name, n AS transaction_count, {money("net")} AS net_revenue,
               {percent("net", "sum(net) OVER (PARTITION BY sales_month)")}
                   AS monthly_revenue_share_percentage,
               CAST(rank() OVER (PARTITION BY sales_month ORDER BY net DESC) AS INT)
                   AS monthly_branch_rank
        FROM branch_months JOIN branches USING (branch_id)"""
    now, then = "total * lag(days) OVER w", "lag(total) OVER w * days"
    q["adv_gold_vs_sales"] = f"""
        SELECT sales_month, {mean_money("total", "days")} AS average_24k_price_per_gram,
               {money("net")} AS net_revenue,
               {growth(now, then)} AS gold_price_change_percentage,
               {growth("net", "lag(net) OVER w")} AS revenue_change_percentage
        FROM months JOIN (
            SELECT CAST(date_trunc('month', price_date) AS DATE) AS sales_month,
                   sum(price_per_gram) AS total, count(*) AS days
            FROM gold_prices JOIN gold_types USING (gold_type_id)
            WHERE gold_type_name = '24K' GROUP BY 1) USING (sales_month)
        WINDOW w AS (ORDER BY sales_month)"""

    q |= {f"v_{name}": text for name, text in views.items()}

    q["x_sales_in_range"] = f"""
        SELECT sale_id, sale_date, branch_id, {money("gross")} AS gross_revenue FROM nx
        WHERE sale_date >= TIMESTAMP '{RANGE_FROM}' AND sale_date < TIMESTAMP '{RANGE_UNTIL}'"""

    # dashboard
    billions = "round({} / 1e9, 2)".format
    q["dash_kpis"] = f"""
        SELECT {billions(money("net"))} AS net_revenue_billions, n AS total_transactions,
               {billions(money("profit"))} AS estimated_profit_billions,
               round({mean_money("net", "n")} / 1e6, 2) AS average_transaction_millions,
               {BIG("units")} AS total_units_sold, n_buyers AS registered_customers
        FROM exec_view"""
    q["dash_monthly_trend"] = f"""
        SELECT CAST(sales_month AS TIMESTAMP) AS sales_month, {money("net")} AS net_revenue,
               {money("profit")} AS estimated_net_profit, n AS transaction_count FROM month_view"""
    q["dash_branch_revenue"] = f"""
        SELECT branch_id, branch_name, {money("coalesce(net, 0)")} AS net_revenue
        FROM branch_view"""
    q["dash_top_customers"] = f"""
        SELECT customer_id, customer_name, {money("spent")} AS total_spent FROM customer_view
        ORDER BY spent DESC, customer_id LIMIT 10"""
    counted = _mix(
        "segments JOIN named USING (customer_id)", "customer_segment", "customer_segment",
        "customer_count", "percentage",
    )
    q["dash_segment_counts"] = counted
    q["dash_customer_table"] = f"""
        SELECT customer_name, city, n AS purchase_count, {money("spent")} AS total_spent,
               coalesce({mean_money("spent", "n")}, 0) AS average_transaction_value
        FROM customer_view"""
    q["dash_top_products"] = f"""
        SELECT product_id, product_name, {money("gross")} AS gross_revenue FROM product_view
        ORDER BY gross DESC, product_id LIMIT 10"""
    q["dash_category_revenue"] = f"""
        SELECT category, {money("sum(gross)")} AS gross_revenue,
               {percent("sum(gross)", "(SELECT sum(gross) FROM product_view)")} AS percentage
        FROM product_view GROUP BY category"""
    q["dash_inventory_status"] = _mix(
        "stock_view", "status", "inventory_status", "inventory_record_count", "percentage"
    )
    q["dash_inventory_table"] = """
        SELECT branch_name, product_name, category, stock_quantity, reorder_level,
               status AS inventory_status FROM stock_view"""
    q["dash_branch_options"] = """
        SELECT 'All Branches' AS branch_name UNION ALL SELECT DISTINCT branch_name FROM staff"""
    chosen = f"WHERE branch_name = '{SELECTED_BRANCH}'"
    q["dash_employee_filter"] = f"""
        SELECT {STAFF_COLUMNS}, branch_id, {money("monthly_target")} AS monthly_target
        FROM staff_view {chosen}"""
    q["dash_top_employees"] = f"""
        SELECT employee_id, employee_name, {money("net")} AS net_revenue FROM staff_view
        ORDER BY net DESC, employee_id LIMIT 10"""
    q["dash_employee_table"] = f"""
        SELECT employee_name, job_title, branch_name, n AS transaction_count,
               {BIG("units")} AS units_sold, {money("net")} AS net_revenue,
               {money("profit")} AS estimated_net_profit FROM staff_view {chosen}"""
    q["dash_make_numeric"] = f"""
        SELECT branch_id, if(branch_id % 5 = 0, NULL, {money("coalesce(net, 0)")}) AS net_revenue,
               {money("coalesce(profit, 0)")} AS estimated_net_profit FROM branch_view"""
    q["dash_first_present_column"] = counted

    # generator rules
    q["gen_date_spine"] = """
        SELECT price_date, i AS day_index, gold_type_id FROM spine"""
    q["gen_average_price"] = f"""
        SELECT gold_type_id, {mean_money("sum(price_per_gram)", "count(*)")} AS average_price
        FROM gold_prices GROUP BY gold_type_id"""
    q["gen_eligible_employees"] = """
        SELECT sale_id, count(h.employee_id) AS eligible_employees
        FROM heads LEFT JOIN hires AS h
             ON h.branch_id = heads.branch_id AND h.hire_date <= sold_on
        GROUP BY sale_id"""
    q["gen_eligible_employee_lists"] = f"""
        SELECT sale_id, count(h.employee_id) AS eligible_employees,
               {BIG("coalesce(sum(h.no * (h.employee_id * 7919 % 1000003)), 0)")} AS list_hash
        FROM heads LEFT JOIN hires AS h
             ON h.branch_id = heads.branch_id AND h.hire_date <= sold_on
        GROUP BY sale_id"""
    q["gen_earliest_employee"] = """
        SELECT branch_id, employee_id, hire_date FROM hires WHERE no = 1"""
    q["gen_fallback_sale_day"] = """
        SELECT sale_id, branch_id, h.employee_id, sold_on AS sale_day, hire_date AS moved_to
        FROM (SELECT sale_id, branch_id, sold_on FROM heads)
             JOIN hires AS h USING (branch_id) WHERE no = 1 AND sold_on < hire_date"""
    q["gen_eligible_customers"] = """
        SELECT sale_id, (SELECT count(*) FROM customers WHERE registration_date <= sold_on)
                            AS eligible_customers FROM heads"""
    # reports that write files and read them back
    q["io_csv_sink"] = q["clean_products"]
    q["io_cached_mart"] = q["v_monthly_sales_summary"]
    q["io_full_refresh"] = q["clean_customers"]
    q["io_create_layers"] = _union(
        [
            f"SELECT '{layer}' AS layer, branch_id, branch_name, city FROM {source}"
            for layer, source in
            {"raw": "raw_branches", "cleaned": "branches", "analytics": "branch_view"}.items()
        ]
    )
    q["x_layout"] = q["x_sales_in_range"]
    q["facts_executive_summary"] = q["v_executive_summary"]
    q["facts_sales_monthly"] = q["sales_monthly"]
    q["facts_sales_in_range"] = q["x_sales_in_range"]
    q["facts_bucketed_net_revenue"] = q["m_sale_net_revenue"]
    for name, keys in {
        "clustered_customer": ["customer_id"],
        "clustered_branch": ["branch_id"],
        "clustered_product": ["product_id"],
        "clustered_branch_product": ["branch_id", "product_id"],
        "filtered_product": ["product_id"],
        "filtered_employee": ["employee_id"],
    }.items():
        where = " AND ".join(f"{key} = {WANTED[key]}" for key in keys)
        q[f"x_{name}"] = f"""
            SELECT sale_id, sale_item_id, product_id, quantity, {money("unit_price")} AS unit_price,
                   customer_id, branch_id, employee_id, sale_date
            FROM sale_items JOIN sales USING (sale_id) WHERE {where}"""
    early = f"sale_date < TIMESTAMP '{BATCH_UNTIL}'"
    q["k_appended_primary_key"] = f"""
        SELECT sale_id, count(*) AS batch_rows,
               sale_id IN (SELECT sale_id FROM raw_sales WHERE {early}) AS is_stored
        FROM (SELECT sale_id FROM raw_sales WHERE NOT ({early})
              UNION ALL SELECT sale_id FROM raw_sales WHERE NOT ({early}) AND sale_id % 89 = 5
              UNION ALL SELECT sale_id FROM raw_sales WHERE {early} AND sale_id % 97 = 3)
        GROUP BY sale_id HAVING batch_rows > 1 OR is_stored"""
    q["k_appended_foreign_key"] = f"""
        SELECT sale_id, count(*) AS batch_rows FROM bad_sale_items
        WHERE sale_id % 9 = 0 AND sale_id NOT IN (SELECT sale_id FROM raw_sales WHERE {early})
        GROUP BY sale_id"""
    q["io_refresh_months"] = q["clean_sales"]
    q["mart_monthly_sales_summary"] = q["v_monthly_sales_summary"]
    q["mart_executive_summary"] = q["v_executive_summary"]
    q["mart_yearly_customers"] = """
        SELECT CAST(year(sales_month) AS INT) AS sales_year,
               count(DISTINCT customer_id) AS registered_customers FROM tx GROUP BY 1"""
    q["mart_branch_customers"] = """
        SELECT branch_id, count(*) AS transaction_count,
               count(DISTINCT customer_id) AS registered_customers FROM tx GROUP BY branch_id"""
    return q


def oracle_sql() -> dict[str, str]:
    return {name: statement(text) for name, text in _statements().items()}
