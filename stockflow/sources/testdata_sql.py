"""The test-table mapping of ``stockflow.sources.testdata`` as DuckDB CTEs.

Used only by ``oracle_sql()``. Each logical table is a named CTE (prefix
``w_`` so it never shadows a registered base view); ``with_tables`` emits a
``WITH RECURSIVE`` header holding the requested CTEs and their dependencies.
"""

from __future__ import annotations

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "w_warehouse": ((), """
        SELECT CAST(r_regionkey AS BIGINT) AS warehouse_id, r_name AS name FROM region"""),
    "w_item": ((), """
        SELECT p_partkey AS item_id, p_name || ' #' || CAST(p_partkey AS VARCHAR) AS name,
               p_type AS category, 'pcs' AS unit_of_measure,
               CAST(p_retailprice AS DECIMAL(12,2)) AS price,
               CAST(p_size AS BIGINT) AS reorder_level
        FROM part"""),
    "w_item_intake": ((), """
        SELECT p_partkey AS staged_id, p_name AS name, p_type AS category,
               CAST(NULL AS VARCHAR) AS unit_of_measure,
               CAST(p_retailprice AS DECIMAL(12,2)) AS price, CAST(p_size AS BIGINT) AS reorder_level
        FROM part"""),
    "w_customer": ((), """
        SELECT c_custkey AS customer_id, c_name AS name FROM customer"""),
    "w_supplier": ((), """
        SELECT s_suppkey AS supplier_id, s_name AS name,
               CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'desk ' || CAST(s_suppkey AS VARCHAR) END AS contact,
               CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'supplier' || CAST(s_suppkey AS VARCHAR) || '@example.com' END AS email,
               CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '+1-555-' || CAST(s_suppkey AS VARCHAR) END AS phone
        FROM supplier"""),
    "w_employee_intake": ((), """
        SELECT user_id AS emp_id, 'Employee#' || CAST(user_id AS VARCHAR) AS name,
               (['Warehouse Manager', 'Receiver', 'Picker', 'Admin', 'Clerk', 'Auditor', 'Supervisor'])[user_id % 7 + 1] AS role_label,
               CASE WHEN user_id % 2 = 0
                    THEN (CASE WHEN user_id % 4 = 0 THEN ' ' ELSE '' END) || 'emp.' || CAST(user_id AS VARCHAR) || '@gmail.com'
                    ELSE 'emp' || CAST(user_id AS VARCHAR) || '@mail.example' END AS contact,
               CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id % 5 END AS warehouse_id,
               CAST(1000 + (user_id % 7) * 250 AS DECIMAL(12,2)) AS monthly_salary
        FROM (SELECT DISTINCT user_id FROM events)"""),
    "w_employee": (("w_employee_intake",), """
        SELECT emp_id, name,
               (['manager', 'staff', 'picker', 'packer', 'driver', 'admin'])[emp_id % 6 + 1] AS role,
               contact, warehouse_id, monthly_salary
        FROM w_employee_intake"""),
    "w_po": ((), """
        SELECT h.l_orderkey AS po_id, h.supplier_id, h.l_orderkey % 5 AS warehouse_id,
               CAST(h.first_ship AS DATE) AS po_date,
               CASE WHEN o.o_orderstatus = 'F' THEN 'RECEIVED' WHEN o.o_orderstatus = 'O' THEN 'APPROVED'
                    WHEN h.l_orderkey % 10 = 0 THEN 'CANCELLED' ELSE 'CREATED' END AS status,
               CAST(o.o_totalprice AS DECIMAL(14,2)) AS total_amount
        FROM (SELECT l_orderkey, min(l_suppkey) AS supplier_id, min(l_shipdate) AS first_ship
              FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey) h
        JOIN orders o ON h.l_orderkey = o.o_orderkey"""),
    "w_pod": (("w_item",), """
        SELECT l.l_orderkey * 1000000 + l.l_partkey AS po_detail_id, l.l_orderkey AS po_id,
               i.item_id, l.quantity, i.price
        FROM (SELECT l_orderkey, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS quantity
              FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey, l_partkey) l
        JOIN w_item i ON l.l_partkey = i.item_id"""),
    "w_so": ((), """
        SELECT o_orderkey AS so_id, o_custkey AS customer_id, o_orderkey % 5 AS warehouse_id,
               CAST(o_orderdate AS DATE) AS so_date,
               CASE WHEN o_orderstatus = 'F' THEN 'SHIPPED' WHEN o_orderstatus = 'O' THEN 'CONFIRMED'
                    WHEN o_orderkey % 10 = 0 THEN 'CANCELLED' ELSE 'NEW' END AS status,
               CAST(o_totalprice AS DECIMAL(14,2)) AS total_amount
        FROM orders"""),
    "w_sod": (("w_item",), """
        SELECT l.l_orderkey * 1000000 + l.l_partkey AS so_detail_id, l.l_orderkey AS so_id,
               i.item_id, l.quantity,
               CAST(round(i.price * (1 + l.tax), 2) AS DECIMAL(12,2)) AS price
        FROM (SELECT l_orderkey, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS quantity,
                     max(CAST(l_tax AS DECIMAL(4,2))) AS tax
              FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey, l_partkey) l
        JOIN w_item i ON l.l_partkey = i.item_id"""),
    "w_stock": (("w_po", "w_pod"), """
        SELECT warehouse_id * 1000000000 + item_id AS stock_id, warehouse_id, item_id,
               CAST(sum(d.quantity) AS BIGINT) AS quantity,
               CAST(max(p.po_date) AS TIMESTAMP) AS last_updated
        FROM w_pod d JOIN w_po p USING (po_id)
        WHERE p.status = 'RECEIVED'
        GROUP BY warehouse_id, item_id"""),
    "w_log": ((), """
        SELECT * FROM (
          SELECT event_id AS log_id, user_id % 5 AS warehouse_id,
                 CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS item_id,
                 CASE WHEN event_type IN ('purchase', 'signup') THEN 'IN'
                      WHEN event_type IN ('view', 'click') THEN 'OUT'
                      WHEN event_type = 'error' THEN 'ADJUST' END AS change_type,
                 CASE WHEN event_type NOT IN ('purchase', 'signup') AND event_id % 2 = 1
                      THEN -CAST(floor(value) AS BIGINT) ELSE CAST(floor(value) AS BIGINT) END AS delta_qty,
                 CASE WHEN event_type IN ('purchase', 'signup') THEN 'PO'
                      WHEN event_type IN ('view', 'click') THEN 'SO' ELSE 'MANUAL' END AS ref_type,
                 CASE WHEN event_type = 'error' THEN NULL ELSE event_id END AS ref_id,
                 user_id AS emp_id, CAST(ts AS TIMESTAMP) AS logged_at
          FROM events)
        WHERE delta_qty <> 0 AND change_type IS NOT NULL"""),
    "w_returns": ((), """
        SELECT (l_orderkey * 1000000 + l_partkey) * 2 + CASE WHEN kind = 'SUPPLIER' THEN 1 ELSE 0 END AS return_id,
               l_orderkey % 5 AS warehouse_id, l_partkey AS item_id, kind,
               CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(min(l_shipdate) AS TIMESTAMP) AS returned_at
        FROM (SELECT *, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'CUSTOMER'
                             WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'SUPPLIER' END AS kind
              FROM lineitem)
        WHERE kind IS NOT NULL
        GROUP BY l_orderkey, l_partkey, kind"""),
    "w_po_intake": ((), """
        SELECT o_orderkey AS staged_id, o_custkey AS supplier_id, o_orderkey % 5 AS warehouse_id,
               CAST(o_orderdate AS DATE) AS po_date FROM orders"""),
    "w_sol_intake": ((), """
        SELECT (l_orderkey * 1000000 + l_partkey) * 100 + l_linenumber AS staged_id, l_orderkey AS so_id,
               l_partkey AS item_id, CAST(l_quantity AS BIGINT) AS quantity,
               CASE WHEN l_linenumber % 2 = 1
                    THEN CAST(CAST(floor(l_extendedprice * 100 / l_quantity) AS DECIMAL(14,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) END AS price
        FROM lineitem WHERE l_linestatus = 'O'"""),
    "w_alerts0": (("w_log", "w_item"), """
        SELECT ((k.warehouse_id * 1000 + k.item_id) * 4 + s.code) AS alert_id, k.warehouse_id, k.item_id,
               CAST(0 AS BIGINT) AS current_quantity, i.reorder_level,
               CAST(NULL AS BIGINT) AS expected_quantity, CAST(s.d AS TIMESTAMP) AS alert_date, s.status
        FROM (SELECT DISTINCT warehouse_id, item_id FROM w_log) k
        JOIN w_item i USING (item_id)
        JOIN (VALUES ('OPEN', 1, '2023-12-01 00:00:00'), ('ACK', 2, '2023-12-15 00:00:00'),
                     ('RESOLVED', 3, '2023-11-01 00:00:00')) s(status, code, d)
          ON (s.status = 'OPEN' AND (k.item_id % 4 IN (1, 3) OR (k.item_id % 4 = 0 AND k.warehouse_id % 2 = 0)))
          OR (s.status = 'ACK' AND k.item_id % 4 IN (2, 3))
          OR (s.status = 'RESOLVED' AND k.item_id % 4 = 0 AND k.warehouse_id % 2 = 0)"""),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in _CTES[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_tables(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH RECURSIVE`` header defining the named logical tables (+ extras)."""
    parts = [f"{n} AS ({_CTES[n][1]}\n)" for n in _order(names)]
    parts += [f"{n} AS ({body}\n)" for n, body in (extra or [])]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
