"""More registered queries: ledgers and alerts after each workflow, intake of every
master and order table, parameterised reads, audits, streams of changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockflow.catalog import (_LEDGER_SQL, _staged_ledger, _SHIPPED_STEPS, AS_OF, NEW_ALERT_ID_OFFSET, REGISTRY, T, W, _ALERT_OUT, _alert_sim, _clip,
                               register)
from stockflow.operators import alerts as alerts_op
from stockflow.operators import orders, views
from stockflow.sources.sinks import snapshot
from stockflow.sources.tables import sql_view
from stockflow.streaming import stateful, streams

_ADJ = ("w_adj", "SELECT *, delta_qty AS signed_qty FROM w_log WHERE change_type = 'ADJUST'")


def _adjustments(t):
    return t.transaction_log.where(F.col("change_type") == "ADJUST").select(
        F.col("log_id").alias("adj_id"), "warehouse_id", "item_id", F.col("delta_qty").alias("delta"),
        "emp_id", F.lit("cycle count").alias("reason"), F.col("logged_at").alias("adjusted_at"))


@register("ship_ledger", W("w_so", "w_sod", "w_stock", "w_log") + _SHIPPED_STEPS + "\n" + _LEDGER_SQL + """so_id, so_detail_id), warehouse_id, item_id, 'OUT',
       -quantity, 'SO', so_id, CAST(NULL AS BIGINT), TIMESTAMP '2026-01-01 00:00:00' FROM gone""")
def q_ship_ledger(spark, d):
    """WF11: the ledger, in its declared schema, after shipping every order that fits."""
    t = T(spark, d)
    return orders.ship_sos(t.sales_order, t.sales_order_details, t.stock, as_of=AS_OF, ledger_log=t.transaction_log)["ledger"]


@register("adjust_ledger", W("w_log", "w_po", "w_pod", "w_stock", extra=[_ADJ, *_clip("w_adj")]) + _LEDGER_SQL + """m.logged_at, m.log_id),
       m.warehouse_id, m.item_id, 'ADJUST', m.signed_qty, 'MANUAL', CAST(NULL AS BIGINT), l.emp_id, m.logged_at
FROM cm m JOIN cf f ON f.warehouse_id = m.warehouse_id AND f.item_id = m.item_id AND f.rn = m.rn
JOIN w_log l ON l.log_id = m.log_id WHERE f.accepted""")
def q_adjust_ledger(spark, d):
    """WF13: the ledger, in its declared schema, after the adjustments that were applied."""
    t = T(spark, d)
    return orders.adjust_stock(t.stock, _adjustments(t), AS_OF, t.transaction_log)["ledger"]


_RECEIVED_OBS = f"""SELECT h.warehouse_id, d.item_id, i.reorder_level AS lvl, TIMESTAMP '{AS_OF}' AS ts,
       d.po_detail_id + {NEW_ALERT_ID_OFFSET} AS nid,
       COALESCE(s.quantity, 0) + sum(d.quantity) OVER w AS q, row_number() OVER w AS orn
FROM w_pod d JOIN w_po h ON h.po_id = d.po_id JOIN w_item i ON i.item_id = d.item_id
LEFT JOIN w_stock s ON s.warehouse_id = h.warehouse_id AND s.item_id = d.item_id
WHERE h.status IN ('CREATED', 'APPROVED', 'PARTIAL')
WINDOW w AS (PARTITION BY h.warehouse_id, d.item_id ORDER BY d.po_detail_id)"""


@register("receive_alerts", W("w_log", "w_po", "w_pod", "w_stock", "w_item", "w_alerts0", extra=_alert_sim(
    "SELECT * FROM w_alerts0", [], _RECEIVED_OBS)) + _ALERT_OUT)
def q_receive_alerts(spark, d):
    """WF10 into WF15: the alert table after every open purchase order is received, line by line."""
    t = T(spark, d)
    r = orders.receive_pos(t.purchase_order, t.purchase_order_details, t.stock, t.purchase_order.select("po_id"), as_of=AS_OF,
                           item=t.item)
    return alerts_op.maintain_alerts(t.reorder_alerts, alerts_op.observations(r["applied"], id_offset=NEW_ALERT_ID_OFFSET),
                                     in_order=True)


@register("adjust_alerts", W("w_log", "w_po", "w_pod", "w_stock", "w_item", "w_alerts0", extra=_alert_sim(
    "SELECT * FROM w_alerts0", [_ADJ, *_clip("w_adj")])) + _ALERT_OUT)
def q_adjust_alerts(spark, d):
    """WF13 into WF15: the alert table after the manual adjustments."""
    t = T(spark, d)
    r = orders.adjust_stock(t.stock, _adjustments(t))
    return alerts_op.maintain_alerts(t.reorder_alerts, alerts_op.observations(r["applied"], t.item, NEW_ALERT_ID_OFFSET))


# ---------------------------------------------------------------- intake
def _decided(staged, r, *cols):
    """Every staged row with the reason for which it was rejected, or null."""
    return staged.select("staged_id", *cols).join(r["rejected"].select("staged_id", "reason"), "staged_id", "left")


@register("add_suppliers", W("w_supplier") + """
, st AS (SELECT supplier_id AS staged_id, CASE supplier_id % 4 WHEN 0 THEN upper(name) WHEN 1 THEN '  '
                WHEN 2 THEN 'New supplier ' || CAST(supplier_id % 20 AS VARCHAR) ELSE 'Supply house ' || CAST(supplier_id AS VARCHAR) END AS name
         FROM w_supplier)
SELECT staged_id, name, CASE WHEN trim(name) = '' THEN 'BLANK_NAME'
       WHEN lower(name) IN (SELECT lower(name) FROM w_supplier) THEN 'DUPLICATE_NAME'
       WHEN staged_id <> min(staged_id) OVER (PARTITION BY lower(name)) THEN 'DUPLICATE_IN_BATCH' END AS reason
FROM st""")
def q_add_suppliers(spark, d):
    """WF4: staged suppliers, some blank, some named like an existing one or like each other."""
    t = T(spark, d)
    k = F.col("supplier_id")
    name = (F.when(k % 4 == 0, F.upper("name")).when(k % 4 == 1, "  ")
            .when(k % 4 == 2, F.concat(F.lit("New supplier "), (k % 20).cast("string")))
            .otherwise(F.concat(F.lit("Supply house "), k.cast("string"))))
    staged = t.supplier.select(k.alias("staged_id"), name.alias("name"), "contact", "email", "phone")
    return _decided(staged, orders.add_master(t.supplier, staged, "supplier_id", "staged_id", ["name"]), "name")


@register("add_customers", W("w_customer") + """
SELECT (SELECT max(customer_id) FROM w_customer) + row_number() OVER (ORDER BY customer_id) AS customer_id,
       'Client ' || CAST(customer_id AS VARCHAR) AS name,
       CASE WHEN customer_id % 3 = 1 THEN CAST(NULL AS VARCHAR) ELSE 'client' || CAST(customer_id AS VARCHAR) || '@example.com' END AS email
FROM w_customer WHERE customer_id % 5 <> 0
UNION ALL SELECT customer_id, name, NULL FROM w_customer""")
def q_add_customers(spark, d):
    """WF4 + SNK1: the customer table after an intake in which every fifth name is blank."""
    t = T(spark, d)
    k = F.col("customer_id")
    staged = t.customer.select(
        k.alias("staged_id"), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("Client "), k.cast("string"))).alias("name"),
        F.when(k % 3 != 1, F.concat(F.lit("client"), k.cast("string"), F.lit("@example.com"))).alias("email"))
    r = orders.add_master(t.customer, staged, "customer_id", "staged_id", ["name"], "email")
    return r["table"].select("customer_id", "name", "email")


@register("create_sos", W("w_so", "w_customer") + """
, st AS (SELECT so_id AS staged_id, customer_id + CASE WHEN so_id % 7 = 0 THEN 1000000000 ELSE 0 END AS customer_id,
                CASE WHEN so_id % 11 = 0 THEN 99 ELSE warehouse_id END AS warehouse_id, so_date FROM w_so),
  ok AS (SELECT * FROM st WHERE customer_id IN (SELECT customer_id FROM w_customer) AND warehouse_id <> 99)
SELECT so_id, customer_id, warehouse_id, so_date, status, total_amount FROM w_so
UNION ALL
SELECT (SELECT max(so_id) FROM w_so) + row_number() OVER (ORDER BY staged_id), customer_id, warehouse_id, so_date, 'NEW',
       CAST(0 AS DECIMAL(14,2)) FROM ok""")
def q_create_sos(spark, d):
    """WF5 + SNK1: sales-order headers; unknown customers and warehouses are left out."""
    t = T(spark, d)
    k = F.col("so_id")
    staged = t.sales_order.select(
        k.alias("staged_id"), (F.col("customer_id") + F.when(k % 7 == 0, 1_000_000_000).otherwise(0)).alias("customer_id"),
        F.when(k % 11 == 0, 99).otherwise(F.col("warehouse_id")).cast("long").alias("warehouse_id"), "so_date")
    r = orders.create_orders(t.sales_order, staged, "so_id", "staged_id",
                             {"customer_id": t.customer, "warehouse_id": t.warehouse}, "NEW")
    return r["table"]


@register("add_po_lines", W("w_po", "w_pod", "w_item") + """
, st AS (SELECT po_detail_id AS staged_id, po_id + CASE WHEN item_id % 13 = 0 THEN 1000000000 ELSE 0 END AS po_id,
                CASE WHEN item_id % 11 = 0 THEN item_id ELSE (item_id + 1) % 2000000000 END AS item_id,
                CASE WHEN item_id % 7 = 0 THEN -quantity ELSE quantity END AS quantity FROM w_pod),
  x AS (SELECT s.*, i.price AS list, s.po_id IN (SELECT po_id FROM w_po) AS known,
               EXISTS (SELECT 1 FROM w_pod d WHERE d.po_id = s.po_id AND d.item_id = s.item_id) AS dup
        FROM st s LEFT JOIN w_item i ON i.item_id = s.item_id),
  y AS (SELECT *, CASE WHEN NOT known THEN 'UNKNOWN_ORDER' WHEN list IS NULL THEN 'UNKNOWN_ITEM'
                       WHEN quantity <= 0 THEN 'BAD_QUANTITY' WHEN dup THEN 'DUPLICATE_LINE' END AS why FROM x)
SELECT staged_id, po_id, item_id, quantity, CAST(COALESCE(list, 0) AS DECIMAL(12,2)) AS price,
       COALESCE(why, CASE WHEN staged_id <> min(CASE WHEN why IS NULL THEN staged_id END) OVER (PARTITION BY po_id, item_id)
                          THEN 'DUPLICATE_LINE' END) AS reason FROM y""")
def q_add_po_lines(spark, d):
    """WF6: staged purchase-order lines take the frozen item price; planted are unknown orders and items,
    negative quantities and (order, item) pairs that exist."""
    t = T(spark, d)
    i = F.col("item_id")
    staged = t.purchase_order_details.select(
        F.col("po_detail_id").alias("staged_id"), (F.col("po_id") + F.when(i % 13 == 0, 1_000_000_000).otherwise(0)).alias("po_id"),
        F.when(i % 11 == 0, i).otherwise(i + 1).alias("item_id"),
        F.when(i % 7 == 0, -F.col("quantity")).otherwise(F.col("quantity")).alias("quantity"))
    r = orders.add_lines(t.purchase_order_details, staged, t.item, "po_id", "po_detail_id", "staged_id", False, t.purchase_order)
    cols = ["staged_id", "po_id", "item_id", "quantity", "price"]
    return r["accepted"].select(*cols, F.lit(None).cast("string").alias("reason")).unionByName(r["rejected"].select(*cols, "reason"))


# ---------------------------------------------------------------- reads
@register("load_items_filtered", W("w_item") + """
SELECT item_id, name, category, price FROM w_item WHERE item_id <= 1500 AND category <> 'O''BRIEN'' OR 1=1' AND price >= 905""")
def q_load_items_filtered(spark, d):
    """SRC4: a query whose values are bound to markers; a quote in a value stays part of it."""
    return sql_view(spark, {}, "SELECT item_id, name, category, price FROM {item} "
                               "WHERE item_id <= :top AND category <> :kind AND price >= :low",
                    {"top": 1500, "kind": "O'BRIEN' OR 1=1", "low": 905}, item=T(spark, d).item)


@register("low_stock_correlated", REGISTRY["low_stock_nested"][1])
def q_low_stock_correlated(spark, d):
    """J6 as written: correlated scalar subqueries."""
    t = T(spark, d)
    return views.low_stock_correlated(t.stock, t.item, t.warehouse)


@register("stock_snapshot", W("w_stock") + """
SELECT warehouse_id, item_id, quantity FROM w_stock""")
def q_stock_snapshot(spark, d):
    """SNK2: the stock table written as a snapshot and read back."""
    t = T(spark, d)
    path = streams.scratch_path(spark, "snapshot")
    snapshot(t.stock, path)
    return spark.read.schema(t.stock.schema).parquet(path).select("warehouse_id", "item_id", "quantity")


# ---------------------------------------------------------------- streams of changes
_CHANGED = """
, changed AS (SELECT so_id, CASE WHEN item_id % 5 = 0 THEN quantity + 3 ELSE quantity END AS quantity, price
              FROM w_sod WHERE item_id % 7 <> 0)"""


@register("stream_totals_changes", W("w_sod") + _CHANGED + """
SELECT s.so_id, CAST(COALESCE((SELECT sum(c.quantity * c.price) FROM changed c WHERE c.so_id = s.so_id), 0) AS DECIMAL(18,2)) AS so_total
FROM (SELECT DISTINCT so_id FROM w_sod) s""")
def q_stream_totals_changes(spark, d):
    """ST3: live totals from a change stream: every line is inserted, every fifth item's lines are updated, every
    seventh's deleted. An order that loses all its lines is left with a total of 0."""
    t = T(spark, d)
    i = F.col("item_id")
    cols = ["so_id", "quantity", "price"]
    none = F.lit(None).cast("struct<so_id:bigint,quantity:bigint,price:decimal(12,2)>")
    row = F.struct(*[F.col(c).cast(k).alias(c) for c, k in zip(cols, ("long", "long", "decimal(12,2)"))])
    later = F.struct(F.col("so_id").cast("long").alias("so_id"),
                     F.when(i % 5 == 0, F.col("quantity") + 3).otherwise(F.col("quantity")).cast("long").alias("quantity"),
                     F.col("price").cast("decimal(12,2)").alias("price"))
    steps = F.array_compact(F.array(
        F.struct(F.lit(1).alias("step"), none.alias("before"), row.alias("after")),
        F.when(i % 5 == 0, F.struct(F.lit(2).alias("step"), row.alias("before"), later.alias("after"))),
        F.when(i % 7 == 0, F.struct(F.lit(3).alias("step"), later.alias("before"), none.alias("after")))))
    changes = t.sales_order_details.select(F.inline(steps))
    path = streams.scratch_path(spark, "st3c-src")
    files = streams.stage_files(changes, path, 4, ["step"])
    signed = streams.signed_lines(streams.read_stream(spark, path, changes.schema, files))
    sink = streams.aggregate_to_snapshots(streams.stream_totals(signed, "so_id", "so_total"), ["so_id"],
                                          spark.createDataFrame([], "so_id long, so_total decimal(18,2)"),
                                          streams.scratch_path(spark, "st3c-out"))
    return sink.current()


@register("stream_pnl", REGISTRY["monthly_pnl"][1])
def q_stream_pnl(spark, d):
    """ST6: live purchases, sales and profit or loss by month: two line streams, one stateful aggregate."""
    t = T(spark, d)

    def dated(lines, header, key, date):
        path = streams.scratch_path(spark, "st6p-src")
        files = streams.stage_files(lines, path, 3, [key, "item_id"])
        return streams.read_stream(spark, path, lines.schema, files).join(
            header.select(key, F.col(date).alias("on_date")), key).select("on_date", "quantity", "price")

    pnl = streams.stream_pnl(dated(t.purchase_order_details, t.purchase_order, "po_id", "po_date"),
                             dated(t.sales_order_details, t.sales_order, "so_id", "so_date"), "on_date")
    none = spark.createDataFrame([], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pnl.schema.fields))
    return streams.aggregate_to_snapshots(pnl, ["month"], none, streams.scratch_path(spark, "st6p-out")).current()


@register("stream_alerts_state", REGISTRY["alerts_with_history"][1])
def q_stream_alerts_state(spark, d):
    """ST2: live alerts by a stateful operator; every key's balance and alerts lie in the state store."""
    t = T(spark, d)
    return stateful.run_alerts_state(_staged_ledger(spark, t, "st2s-src"), t.stock, t.reorder_alerts, t.item,
                                     streams.scratch_path(spark, "st2s-out"), NEW_ALERT_ID_OFFSET)
