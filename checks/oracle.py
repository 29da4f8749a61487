"""DuckDB statements that state each report independently of Spark.

Money is kept in whole cents and weights in hundredths of a gram, so every sum
is an integer and every rounded quotient is an integer division.
"""

from __future__ import annotations

import re

from countinghouse.plans.customers import OTHER_SEGMENT, SEGMENT_RULES
from countinghouse.schemas import TABLES
from countinghouse.sources.star import thousandths


def money(cents: str) -> str:
    return f"CAST({cents} AS DOUBLE) / 100"


def ratio(top: str, bottom: str, digits: int = 2) -> str:
    """``top / bottom`` rounded half away from zero."""
    n, d, k = f"CAST({top} AS HUGEINT)", f"CAST({bottom} AS HUGEINT)", 10**digits
    size = f"((abs({n}) * {2 * k} + abs({d})) // (2 * abs({d})))"
    sign = f"(CASE WHEN ({n} < 0) <> ({d} < 0) THEN -1 ELSE 1 END)"
    return f"(CASE WHEN {d} <> 0 THEN CAST({sign} * {size} AS DOUBLE) / {k} END)"


def percent(part: str, whole: str) -> str:
    return ratio(f"100 * ({part})", whole)


def mean_money(cents: str, count: str) -> str:
    return f"({ratio(cents, f'100 * ({count})')})"


def growth(now: str, before: str) -> str:
    return percent(f"({now}) - ({before})", before)


def words(text: str) -> str:
    parts = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+')"
    return f"array_to_string(list_transform({parts}, lambda w: upper(w[1]) || w[2:]), '')"


def cents(column: str) -> str:
    return f"CAST(round(CAST({column} AS DECIMAL(14,2)) * 100) AS BIGINT)"


CTES: dict[str, str] = {
    "n_supp": "SELECT count(*) AS n FROM supplier",
    "n_part": "SELECT count(*) AS n FROM part",
    "parts": """
        SELECT * FROM part
        UNION ALL
        SELECT * EXCLUDE (n) REPLACE (p_partkey + n AS p_partkey)
        FROM part, n_part WHERE p_partkey % 40 = 7""",
    "raw_branches": """
        SELECT CAST(n_nationkey AS BIGINT) AS branch_id,
               '  ' || lower(n_name) || ' branch ' AS branch_name, ' ' || lower(r_name) AS city,
               CAST(DATE '1994-01-01' + n_nationkey * 40 AS DATE) AS opening_date
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "raw_customers": """
        SELECT c_custkey AS customer_id,
               '  customer#' || lpad(CAST(k AS VARCHAR), 9, '0') || ' ' AS customer_name,
               CASE WHEN k % 20 = 0 THEN NULL WHEN k % 20 = 1 THEN '   '
                    ELSE '09' || (100000000 + k) END AS phone,
               CASE WHEN c_custkey % 12 = 0 THEN NULL WHEN c_custkey % 12 = 1 THEN '  '
                    ELSE ' ' || lower(c_mktsegment) END AS city,
               CAST(DATE '1992-01-01' + CAST(c_custkey * 37 % 1500 AS INT) AS DATE)
                   AS registration_date
        FROM (SELECT *, CASE WHEN c_custkey % 50 = 3 THEN c_custkey - 1 ELSE c_custkey END AS k
              FROM customer)""",
    "raw_suppliers": """
        SELECT s_suppkey AS supplier_id, ' ' || lower(s_name) || '-supply co ' AS supplier_name,
               CASE WHEN s_suppkey % 9 <> 0 THEN ' nation ' || s_nationkey END AS city,
               CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 10 = 1 THEN ''
                    ELSE '09' || (200000000 + s_suppkey) END AS phone
        FROM supplier""",
    "raw_gold_types": """
        SELECT DISTINCT p_partkey % 4 + 1 AS gold_type_id,
               CASE p_partkey % 4 WHEN 0 THEN ' 24k ' WHEN 1 THEN '22K' WHEN 2 THEN '18k'
                    ELSE '14K' END AS gold_type_name
        FROM part""",
    "raw_employees": """
        SELECT s_suppkey AS employee_id,
               'employee#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS employee_name,
               CAST(s_nationkey AS BIGINT) AS branch_id,
               CASE s_suppkey % 8 WHEN 0 THEN 'branch manager' WHEN 1 THEN 'senior sales associate'
                    WHEN 2 THEN 'cashier' ELSE 'sales associate' END AS job_title,
               CAST(DATE '1994-06-01' + CAST(s_suppkey * 53 % 700 AS INT) AS DATE) AS hire_date,
               (5000000 + s_suppkey % 51 * 500000) * 100 AS monthly_target
        FROM supplier""",
    "raw_products": f"""
        SELECT p_partkey AS product_id, ' ' || p_name || ' ' AS product_name,
               lower(p_type) AS category, p_partkey % 4 + 1 AS gold_type_id,
               CAST(p_size AS BIGINT) * 100 AS weight_grams,
               CAST(p_size AS BIGINT) * 100000 AS making_charge,
               {cents("p_retailprice")} * 30 AS cost_price,
               {cents("p_retailprice")} * 40 AS selling_price,
               p_partkey % (n - 1) AS supplier_id
        FROM parts, n_supp""",
    "raw_sales": f"""
        SELECT o_orderkey AS sale_id,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS customer_id,
               s_suppkey AS employee_id,
               CAST(CASE WHEN o_orderkey % 50 = 0 THEN (s_nationkey + 1) % 25
                         ELSE s_nationkey END AS BIGINT) AS branch_id,
               o_orderdate + to_seconds(32400 + o_orderkey * 7919 % 36000) AS sale_date,
               ' ' || o_orderpriority AS payment_method,
               CASE WHEN o_orderkey % 20 < 7 THEN ({cents("o_totalprice")} * 5 + 50) // 100
                    ELSE 0 END AS discount_amount
        FROM orders, n_supp, supplier WHERE s_suppkey = o_orderkey % (n - 1)""",
    "raw_sale_items": f"""
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sale_item_id,
               l_orderkey AS sale_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity,
               {cents("l_extendedprice")} AS unit_price
        FROM lineitem""",
    "raw_inventory": """
        SELECT n_nationkey * 2 * n + p_partkey + 1 AS inventory_id,
               CAST(n_nationkey AS BIGINT) AS branch_id, p_partkey AS product_id,
               CAST((p_partkey * 7 + n_nationkey * 3) % 16 AS INT) AS stock_quantity,
               CAST(2 + (p_partkey + n_nationkey) % 4 AS INT) AS reorder_level,
               CAST(DATE '2001-07-01' + CAST((p_partkey + n_nationkey) % 31 AS INT) AS DATE)
                   AS last_updated
        FROM parts JOIN nation ON (n_nationkey - p_partkey) % 5 = 0, n_part""",
    "spine": """
        SELECT CAST(d AS DATE) AS price_date, gold_type_id,
               date_diff('day', first, CAST(d AS DATE)) AS i
        FROM (SELECT CAST(min(o_orderdate) AS DATE) AS first, unnest(generate_series(
                  CAST(CAST(min(o_orderdate) AS DATE) AS TIMESTAMP),
                  CAST(CAST(max(o_orderdate) AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS d
              FROM orders), raw_gold_types""",
    "raw_gold_prices": f"""
        SELECT price_date, gold_type_id,
               ((180000 + 20 * i + i * 7919 % 2000)
                * {thousandths()}[gold_type_id] + 50000) // 100000 * 10000 AS price_per_gram
        FROM spine""",
    "branches": f"""
        SELECT branch_id, {words("trim(branch_name)")} AS branch_name,
               {words("trim(city)")} AS city, opening_date FROM raw_branches""",
    "customers": f"""
        SELECT customer_id, {words("trim(customer_name)")} AS customer_name,
               nullif(trim(phone), '') AS phone, {words("nullif(trim(city), '')")} AS city,
               registration_date FROM raw_customers""",
    "suppliers": f"""
        SELECT supplier_id, {words("trim(supplier_name)")} AS supplier_name,
               {words("nullif(trim(city), '')")} AS city, nullif(trim(phone), '') AS phone
        FROM raw_suppliers""",
    "gold_types": "SELECT gold_type_id, upper(trim(gold_type_name)) AS gold_type_name"
    " FROM raw_gold_types",
    "employees": f"""
        SELECT * REPLACE ({words("trim(employee_name)")} AS employee_name,
                          {words("trim(job_title)")} AS job_title) FROM raw_employees""",
    "products": f"""
        SELECT * REPLACE (trim(product_name) AS product_name,
                          {words("trim(category)")} AS category) FROM raw_products""",
    "sales": f"""
        SELECT * REPLACE ({words("trim(payment_method)")} AS payment_method) FROM raw_sales""",
    "sale_items": "SELECT * FROM raw_sale_items",
    "inventory": "SELECT * FROM raw_inventory",
    "gold_prices": "SELECT * FROM raw_gold_prices",
    "bad_branches": """
        SELECT branch_id, branch_name, city,
               CASE WHEN branch_id = 24 THEN DATE '2030-01-01' ELSE opening_date END AS opening_date
        FROM raw_branches, range(CASE WHEN branch_id = 0 THEN 2 ELSE 1 END)""",
    "bad_customers": """
        SELECT * REPLACE (
            CASE WHEN customer_id % 200 <> 15 THEN customer_name END AS customer_name,
            CASE WHEN customer_id % 200 = 16 THEN repeat('9', 40) ELSE phone END AS phone)
        FROM raw_customers""",
    "bad_suppliers": "SELECT * FROM raw_suppliers",
    "bad_gold_types": "SELECT * FROM raw_gold_types",
    "bad_employees": """
        SELECT * REPLACE (
            CASE WHEN employee_id % 10 = 4 THEN -100 ELSE monthly_target END AS monthly_target,
            CASE WHEN employee_id % 10 <> 5 THEN hire_date END AS hire_date)
        FROM raw_employees""",
    "bad_products": """
        SELECT * REPLACE (
            CASE WHEN product_id % 50 = 11 THEN 0 ELSE cost_price END AS cost_price,
            CASE WHEN product_id % 50 = 12 THEN -100 ELSE weight_grams END AS weight_grams)
        FROM raw_products""",
    "bad_sales": """
        SELECT * REPLACE (
            CASE WHEN sale_id % 80 = 9 THEN -100 ELSE discount_amount END AS discount_amount,
            CASE WHEN sale_id % 90 = 5 AND customer_id IS NOT NULL THEN -1
                 ELSE customer_id END AS customer_id,
            CASE WHEN sale_id % 95 = 7 THEN -1 ELSE employee_id END AS employee_id)
        FROM raw_sales""",
    "bad_sale_items": """
        SELECT * REPLACE (
            CASE WHEN sale_id % 70 = 3 THEN 0 ELSE quantity END AS quantity,
            CASE WHEN sale_id % 70 = 4 THEN 0 ELSE unit_price END AS unit_price,
            CASE WHEN sale_id % 90 = 5 THEN -1 ELSE product_id END AS product_id,
            CASE WHEN sale_id % 110 = 6 THEN -sale_id ELSE sale_id END AS sale_id)
        FROM raw_sale_items""",
    "bad_inventory": """
        SELECT inventory_id, branch_id, product_id,
               CASE WHEN product_id % 60 = 8 THEN -1 ELSE stock_quantity END AS stock_quantity,
               CASE WHEN product_id % 60 = 9 THEN -2 ELSE reorder_level END AS reorder_level,
               last_updated
        FROM raw_inventory, range(CASE WHEN branch_id = 0 AND product_id < 3 THEN 2 ELSE 1 END)""",
    "bad_gold_prices": """
        SELECT * REPLACE (CASE WHEN gold_type_id = 4 AND month(price_date) = 1
                                    AND day(price_date) = 1 THEN 0 ELSE price_per_gram END
                          AS price_per_gram) FROM raw_gold_prices""",
    "lines": """
        SELECT sale_id, product_id, product_name, category, quantity AS q,
               quantity::HUGEINT * unit_price AS rev,
               quantity::HUGEINT * (unit_price - cost_price) AS gain
        FROM sale_items JOIN products USING (product_id)""",
    "heads": """
        SELECT *, CAST(sale_date AS DATE) AS sold_on,
               CAST(date_trunc('month', sale_date) AS DATE) AS sales_month FROM sales""",
    "tx": """
        SELECT heads.*, units, gross, gross - discount_amount AS net,
               gain - discount_amount AS profit
        FROM heads JOIN (SELECT sale_id, sum(q) AS units, sum(rev) AS gross, sum(gain) AS gain
                         FROM lines GROUP BY sale_id) USING (sale_id)""",
    "nx": """
        SELECT heads.*, gross, gross - discount_amount AS net
        FROM heads JOIN (SELECT sale_id, sum(quantity::HUGEINT * unit_price) AS gross
                         FROM sale_items GROUP BY sale_id) USING (sale_id)""",
    "today": "SELECT CAST(max(sale_date) AS DATE) AS today FROM sales",
    "split": """
        SELECT lines.*, CAST(CAST(discount_amount AS DOUBLE) / 100 * (CAST(rev AS DOUBLE) / 100)
                             / nullif(CAST(gross AS DOUBLE) / 100, 0) AS DECIMAL(30, 12)) AS cut
        FROM lines JOIN tx USING (sale_id)""",
    "months": "SELECT sales_month, sum(net) AS net FROM nx GROUP BY ALL",
    "branch_months": "SELECT branch_id, sales_month, count(*) AS n, sum(net) AS net"
    " FROM nx GROUP BY ALL",
    "buyers": """
        SELECT customer_id, count(*) AS n, min(sold_on) AS first_on, max(sold_on) AS last_on,
               sum(net) AS spent
        FROM nx WHERE customer_id IS NOT NULL GROUP BY customer_id""",
    "named": "SELECT customer_id, customer_name, coalesce(city, 'Unknown') AS city FROM customers",
    "rfm": """
        SELECT customer_id, date_diff('day', last_on, today) + 1 AS recency, n AS frequency, spent,
               ntile(5) OVER (ORDER BY last_on, customer_id) AS r,
               ntile(5) OVER (ORDER BY n, customer_id) AS f,
               ntile(5) OVER (ORDER BY spent, customer_id) AS m
        FROM buyers, today""",
    "segments": f"""
        SELECT *, CASE {" ".join(f"WHEN {rule} THEN '{name}'" for name, rule in SEGMENT_RULES)}
                       ELSE '{OTHER_SEGMENT}' END AS customer_segment
        FROM (SELECT *, r AS recency_score, f AS frequency_score, m AS monetary_score FROM rfm)""",
    "stock": "SELECT product_id, CAST(sum(stock_quantity) AS BIGINT) AS stock"
    " FROM inventory GROUP BY product_id",
    "sold": """
        SELECT product_id, count(*) AS n_lines, count(DISTINCT sale_id) AS n_sales,
               sum(quantity) AS units, sum(quantity::HUGEINT * unit_price) AS gross
        FROM sale_items GROUP BY product_id""",
    "product_view": """
        SELECT product_id, product_name, category, gold_type_name, coalesce(n_sales, 0) AS n_sales,
               coalesce(units, 0) AS units, coalesce(gross, 0) AS gross,
               coalesce(gross - units * cost_price, 0) AS gain
        FROM products JOIN gold_types USING (gold_type_id) LEFT JOIN sold USING (product_id)""",
    "stock_view": """
        SELECT v.*, branch_name, product_name, category, stock_quantity * cost_price AS cost,
               stock_quantity * selling_price AS retail,
               CASE WHEN stock_quantity = 0 THEN 'Out of Stock'
                    WHEN stock_quantity > reorder_level THEN 'Healthy Stock'
                    ELSE 'Low Stock' END AS status
        FROM inventory v JOIN branches USING (branch_id) JOIN products USING (product_id)""",
    "staff": "SELECT employees.*, branch_name FROM employees JOIN branches USING (branch_id)",
    "staff_view": """
        SELECT staff.*, coalesce(n, 0) AS n, coalesce(units, 0) AS units, coalesce(net, 0) AS net,
               coalesce(profit, 0) AS profit
        FROM staff LEFT JOIN (SELECT employee_id, count(*) AS n, sum(units) AS units,
                                     sum(net) AS net, sum(profit) AS profit
                              FROM tx GROUP BY employee_id) USING (employee_id)""",
    "staff_months": """
        SELECT staff.*, sales_month, n, net
        FROM staff JOIN (SELECT employee_id, sales_month, count(*) AS n, sum(net) AS net
                         FROM nx GROUP BY ALL) USING (employee_id)""",
    "branch_view": """
        SELECT branch_id, branch_name, city, coalesce(n, 0) AS n, coalesce(buyers, 0) AS n_buyers,
               units, gross, discounts, net, profit
        FROM branches LEFT JOIN (
            SELECT branch_id, count(*) AS n, count(DISTINCT customer_id) AS buyers,
                   sum(units) AS units, sum(gross) AS gross, sum(discount_amount) AS discounts,
                   sum(net) AS net, sum(profit) AS profit
            FROM tx GROUP BY branch_id) USING (branch_id)""",
    "customer_view": """
        SELECT customer_id, customer_name, city, coalesce(n, 0) AS n, first_on, last_on,
               coalesce(spent, 0) AS spent
        FROM named LEFT JOIN buyers USING (customer_id)""",
    "exec_view": """
        SELECT count(*) AS n, count(DISTINCT customer_id) AS n_buyers,
               count(DISTINCT branch_id) AS n_branches, sum(units) AS units, sum(gross) AS gross,
               sum(discount_amount) AS discounts, sum(net) AS net, sum(profit) AS profit
        FROM tx""",
    "month_view": """
        SELECT sales_month, count(*) AS n, count(DISTINCT customer_id) AS n_buyers,
               sum(units) AS units, sum(gross) AS gross, sum(discount_amount) AS discounts,
               sum(net) AS net, sum(profit) AS profit
        FROM tx GROUP BY sales_month""",
    "hires": """
        SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY hire_date, employee_id) AS no
        FROM employees""",
}


def _judged_ctes() -> dict[str, str]:
    """Every table with the reasons its rows would be rejected for."""
    ctes = {}
    for name, spec in TABLES.items():
        reasons = [
            f"CASE WHEN {c} IS NULL THEN 'not_null:{c}' END" for c in spec.required
        ] + [f"CASE WHEN NOT ({p}) THEN 'check:{c}' END" for c, p in spec.checks.items()]
        reasons += [
            f"CASE WHEN length({c}) > {n} THEN 'type:{c}' END"
            for c, n in spec.text_limits.items()
        ]
        for key in (spec.key, *spec.unique):
            known = " AND ".join(f"{c} IS NOT NULL" for c in key)
            reasons.append(
                f"CASE WHEN {known} AND count(*) OVER (PARTITION BY {', '.join(key)}) > 1"
                f" THEN 'unique:{','.join(key)}' END"
            )
        for c, parent in spec.parents.items():
            kept = f"SELECT {TABLES[parent].key[0]} FROM judged_{parent} WHERE len(reasons) = 0"
            reasons.append(f"CASE WHEN {c} NOT IN ({kept}) THEN 'foreign_key:{c}' END")
        ctes[f"judged_{name}"] = (
            f"SELECT *, list_filter([{', '.join(reasons)}], lambda x: x IS NOT NULL) AS reasons"
            f" FROM bad_{name}"
        )
    return ctes


CTES |= _judged_ctes()


def statement(query: str) -> str:
    """``query`` with the common tables it needs, in order of dependence."""
    seen: set[str] = set()
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(body)
                needed.append(name)

    visit(query)
    if not needed:
        return query
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in needed) + "\n" + query
