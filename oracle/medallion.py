"""Medallion, quality, remediation and perturbation."""

SQL = {
    "silver_customers": "SELECT * FROM customers_silver",
    "silver_products": "SELECT * FROM products_silver",
    "silver_orders": "SELECT * FROM orders_silver",
    "silver_events": "SELECT * FROM events_silver",
    "silver_reviews": "SELECT * FROM reviews_silver",
    "dim_customer_scd2": """
        SELECT customer_id, email, full_name, country, created_at AS effective_from,
               CAST(NULL AS TIMESTAMP) AS effective_to, true AS is_current, updated_at AS source_updated_at
        FROM customers_silver""",
    "dim_product": "SELECT * FROM products_silver",
    "fact_orders": """
        SELECT order_id, customer_id, product_id, quantity, order_ts, order_date, status, amount_usd
        FROM orders_silver""",
    "daily_order_metrics": """
        SELECT order_date, count(*) AS order_count, CAST(sum(quantity) AS BIGINT) AS units_sold,
               round(CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE), 2) AS revenue_usd,
               count(DISTINCT customer_id) AS unique_customers
        FROM orders_silver GROUP BY order_date""",
    "layer_row_counts": """
        SELECT 'silver.customers' AS table_name, count(*) AS row_count FROM customers_silver
        UNION ALL SELECT 'silver.products', count(*) FROM products_silver
        UNION ALL SELECT 'silver.orders', count(*) FROM orders_silver
        UNION ALL SELECT 'silver.events', count(*) FROM events_silver
        UNION ALL SELECT 'silver.reviews', count(*) FROM reviews_silver
        UNION ALL SELECT 'gold.dim_product', count(*) FROM products_silver
        UNION ALL SELECT 'gold.dim_customer', count(*) FROM customers_silver
        UNION ALL SELECT 'gold.fact_orders', count(*) FROM orders_silver
        UNION ALL SELECT 'gold.daily_order_metrics', count(DISTINCT order_date) FROM orders_silver
        UNION ALL SELECT 'bronze.customers', count(*) FROM customer
        UNION ALL SELECT 'bronze.products', count(*) FROM part
        UNION ALL SELECT 'bronze.orders', count(*) FROM lineitem
        UNION ALL SELECT 'bronze.events', count(*) FROM events
        UNION ALL SELECT 'bronze.reviews', count(*) FROM conversations""",
    "orphan_keys": """
        SELECT order_id, 'customer_id' AS key_name, customer_id AS key_value FROM orders_silver o
        WHERE NOT EXISTS (SELECT 1 FROM customers_silver c WHERE c.customer_id = o.customer_id)
        UNION ALL
        SELECT order_id, 'product_id', product_id FROM orders_silver o
        WHERE NOT EXISTS (SELECT 1 FROM products_silver p WHERE p.product_id = o.product_id)""",
    "stable_id": "SELECT o_orderkey, substr(sha1('42:order:' || o_orderkey), 1, 12) AS stable_id FROM orders",
    "scd2_apply": """
        SELECT customer_id, email, full_name, country, created_at AS effective_from,
               CASE WHEN moved THEN updated_at + INTERVAL 30 DAY END AS effective_to, NOT moved AS is_current,
               updated_at AS source_updated_at
        FROM (SELECT *, CAST(customer_id AS BIGINT) % 5 = 0 AND country <> 'MOVED' AS moved FROM customers_silver)
        WHERE CAST(customer_id AS BIGINT) % 7 <> 0
        UNION ALL
        SELECT customer_id, email, full_name,
               CASE WHEN CAST(customer_id AS BIGINT) % 5 = 0 THEN 'MOVED' ELSE country END,
               updated_at + INTERVAL 30 DAY, NULL, true, updated_at + INTERVAL 30 DAY
        FROM customers_silver
        WHERE CAST(customer_id AS BIGINT) % 7 = 0 OR CAST(customer_id AS BIGINT) % 5 = 0""",
    "dup_rate": """
        SELECT count(*) AS row_count,
               round(CAST(count(*) - count(DISTINCT order_id) AS DOUBLE) / count(*), 6) AS duplicate_rate
        FROM raw_lines""",
    "stream_late_share": """
        SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, count(*) FILTER (k * 60 > 2880) AS late,
               round(avg(CASE WHEN k * 60 > 2880 THEN 1.0 ELSE 0.0 END), 6) AS pct_late
        FROM events_k GROUP BY 1""",
    "pct_late": "SELECT round(avg(CASE WHEN k * 60 > 2880 THEN 1.0 ELSE 0.0 END), 6) AS pct_late FROM events_k",
    "dq_results": "SELECT * REPLACE (round(observed_value, 6) AS observed_value) FROM dq_facts",
    "dq_summary": """
        SELECT count(*) AS checks_total, count(*) FILTER (passed) AS checks_passed,
               count(*) FILTER (NOT passed) AS checks_failed
        FROM dq_facts""",
    "dq_failures": """
        SELECT run_id, pipeline_key, check_name, table_name, metric_name,
               round(observed_value, 6) AS observed_value, threshold_value, comparator, passed, checked_at
        FROM dq_facts WHERE NOT passed""",
    "free_sql_checks": """
        SELECT check_name, 'lines' AS table_name, 'value' AS metric_name, round(v, 6) AS observed_value, lim AS threshold_value,
               comparator, CASE comparator WHEN '==' THEN v = lim WHEN '<=' THEN v <= lim WHEN '<' THEN v < lim
                 WHEN '>=' THEN v >= lim ELSE v > lim END AS passed
        FROM (SELECT unnest([
          {'check_name': 'negative_amounts', 'comparator': '==', 'lim': 0.0::DOUBLE, 'v': (count(*) FILTER (amount_usd < 0))::DOUBLE},
          {'check_name': 'returned_share', 'comparator': '<=', 'lim': 0.3::DOUBLE, 'v': count(*) FILTER (status = 'Returned') / count(*)},
          {'check_name': 'median_quantity', 'comparator': '>=', 'lim': 30.0::DOUBLE, 'v': quantile_cont(quantity::DOUBLE, 0.5)},
          {'check_name': 'distinct_suppliers', 'comparator': '>', 'lim': 5.0::DOUBLE, 'v': count(DISTINCT l_suppkey)::DOUBLE},
          {'check_name': 'amount_of_small_orders', 'comparator': '<', 'lim': 1e12::DOUBLE,
           'v': round(sum(amount_usd) FILTER (quantity < 10), 2)::DOUBLE}], recursive := true) FROM raw_lines)""",
    "sample_bad_records": """
        SELECT customer_id, CAST(NULL AS VARCHAR) AS email, full_name, country, created_at, updated_at
        FROM customers_silver WHERE CAST(customer_id AS BIGINT) % 2 = 0 ORDER BY customer_id LIMIT 5""",
    "quarantine_nulls": """
        SELECT customer_id, CASE WHEN CAST(customer_id AS BIGINT) % 2 = 1 THEN email END AS email,
               CAST(customer_id AS BIGINT) % 2 = 0 AS is_quarantined
        FROM customers_silver""",
    "quarantine_duplicates": """
        SELECT order_id, product_id, quantity, order_ts, status, amount_usd, l_suppkey,
               row_number() OVER (PARTITION BY order_id ORDER BY order_ts DESC, product_id, quantity, status,
                                  amount_usd, l_suppkey) > 1 AS is_quarantined
        FROM raw_lines""",
    "quarantine_copies": """
        SELECT f AS is_quarantined, count(*) AS n, count(DISTINCT order_id) AS n_keys,
               CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS amount
        FROM orders_silver, (VALUES (true), (false)) v(f) GROUP BY f""",
    "replay_window": """
        SELECT event_id, event_ts, process_ts FROM events_silver
        WHERE event_ts >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR""",
    "apply_additive": """
        SELECT product_id, sku, name, category AS product_category_v2, price_usd, is_active, updated_at, category
        FROM products_raw""",
    "perturb_nulls": """
        SELECT customer_id, CASE WHEN CAST(customer_id AS BIGINT) % 2 = 1 THEN email END AS email
        FROM customers_silver""",
    "perturb_volume": """
        SELECT order_id, product_id, order_ts, amount_usd FROM raw_lines
        WHERE (l_orderkey * 8 + l_linenumber) % 20 = 0""",
    "perturb_duplicate": """
        SELECT order_id, customer_id, amount_usd FROM orders_silver
        UNION ALL SELECT order_id, customer_id, amount_usd FROM orders_silver""",
    "perturb_schema": """
        SELECT product_id, sku, name, category AS product_category_v2, price_usd, is_active, updated_at
        FROM products_raw""",
    "perturb_late": """
        SELECT event_id, event_ts - INTERVAL 96 HOUR AS event_ts, CAST(6000.0 AS DOUBLE) AS lag_minutes
        FROM events_silver""",
}
