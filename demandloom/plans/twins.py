"""SQL views the twins share. Each twin is WITH <views> SELECT ..."""

VIEWS = {
    "dp_flat": """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS sales_id,
       concat_ws('|', p_brand, p_type, c_mktsegment, n_name) AS master_id,
       p_brand AS product, p_type AS product_group, c_mktsegment AS customer,
       n_name AS location, r_name AS location_region,
       CAST(l_shipdate AS DATE) AS sale_date,
       CAST(l_quantity AS DOUBLE) AS quantity,
       'EA' AS uom,
       l_extendedprice / l_quantity AS unit_price,
       CAST(o_orderdate AS DATE) AS created_at,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""",
    "dp_master": "SELECT DISTINCT master_id, product, product_group, customer, location, location_region FROM dp_flat",
    "dp_sales": "SELECT sales_id, master_id, sale_date, quantity, uom, unit_price, created_at FROM dp_flat",
    "dp_factors": """
SELECT o_orderpriority AS factor_name,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS factor_date,
       round(avg(o_totalprice), 2) AS factor_value
FROM orders GROUP BY ALL""",
    "dp_series": """
SELECT m.product AS product, CAST(date_trunc('month', s.sale_date) AS DATE) AS period,
       sum(s.quantity) AS total_quantity, count(DISTINCT s.sales_id) AS transaction_count
FROM dp_sales s JOIN dp_master m ON s.master_id = m.master_id GROUP BY ALL""",
    "dp_plan": """
SELECT master_id, CAST(date_trunc('month', sale_date) AS DATE) AS plan_date,
       sum(quantity) AS quantity, max(uom) AS uom,
       CASE WHEN sum(quantity) > 60 THEN 'manual' ELSE 'disaggregated' END AS plan_type
FROM dp_sales GROUP BY ALL""",
    "dp_request_log": """
SELECT event_id AS log_id, event_type AS operation, ts AS start_time,
       value AS duration_seconds, props AS payload, user_id FROM events""",
}

_NEEDS = {
    "dp_master": ["dp_flat"],
    "dp_sales": ["dp_flat"],
    "dp_series": ["dp_master", "dp_sales"],
    "dp_plan": ["dp_sales"],
}


def add_view(name: str, sql: str, needs: list[str] = ()) -> None:
    VIEWS[name] = sql
    _NEEDS[name] = list(needs)


def with_views(*names: str, then: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in _NEEDS.get(name, []):
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {views}\n{then.strip()}"
