"""Logical inventory tables derived from the Parquet test data.

The provided Parquet files are TPC-H-like tables with no inventory schema;
this module maps them onto the inventory schema (see FIXTURES.md section B).
It only shapes stand-in input rows -- every operator under test does its own
work on them. ``stockflow.sources.testdata_sql`` holds the same mapping as
DuckDB SQL for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.schemas import HEADER_TOTAL, MONEY

N_WAREHOUSES = 5      # region has 5 rows; order keys map onto them by modulo
EVENT_ITEMS = 20      # movement stream touches items 0..19
DETAIL_KEY = 1_000_000  # composite detail id = order key * DETAIL_KEY + part key


def _lit_null(t):
    return F.lit(None).cast(t)


class TestTables:
    """Lazily derived logical tables for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- master data -------------------------------------------------
    @cached_property
    def warehouse(self) -> DataFrame:
        return self.raw("region").select(
            F.col("r_regionkey").cast("long").alias("warehouse_id"),
            F.col("r_name").alias("name"),
            _lit_null("string").alias("address"), _lit_null("string").alias("city"),
            _lit_null("string").alias("state"), _lit_null("string").alias("zip"),
            _lit_null("long").alias("capacity"), _lit_null("long").alias("manager_id"))

    @cached_property
    def item(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("item_id"),
            F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("name"),
            F.col("p_type").alias("category"),
            F.lit("pcs").alias("unit_of_measure"),
            F.col("p_retailprice").cast(MONEY).alias("price"),
            F.col("p_size").cast("long").alias("reorder_level"))

    @cached_property
    def item_intake(self) -> DataFrame:
        """Staged new items as typed by users: raw part names (they repeat)."""
        return self.raw("part").select(
            F.col("p_partkey").alias("staged_id"), F.col("p_name").alias("name"),
            F.col("p_type").alias("category"), _lit_null("string").alias("unit_of_measure"),
            F.col("p_retailprice").cast(MONEY).alias("price"),
            F.col("p_size").cast("long").alias("reorder_level"))

    @cached_property
    def customer(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
            _lit_null("string").alias("email"), _lit_null("string").alias("phone"),
            _lit_null("string").alias("address"))

    @cached_property
    def supplier(self) -> DataFrame:
        k = F.col("s_suppkey")
        ks = k.cast("string")
        return self.raw("supplier").select(
            k.alias("supplier_id"), F.col("s_name").alias("name"),
            F.when(k % 2 == 0, _lit_null("string")).otherwise(F.concat(F.lit("desk "), ks)).alias("contact"),
            F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("supplier"), ks, F.lit("@example.com"))).alias("email"),
            F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("+1-555-"), ks)).alias("phone"),
            _lit_null("string").alias("address"))

    @cached_property
    def employee_intake(self) -> DataFrame:
        """Staged employees: one per distinct events user, role as a UI label."""
        # The role labels offered by the reference's form.
        labels = ["Warehouse Manager", "Receiver", "Picker", "Admin", "Clerk", "Auditor", "Supervisor"]
        n = F.col("user_id")
        ns = n.cast("string")
        return (self.raw("events").select("user_id").distinct().select(
            n.alias("emp_id"),
            F.concat(F.lit("Employee#"), ns).alias("name"),
            F.element_at(F.array(*[F.lit(x) for x in labels]), (n % 7 + 1).cast("int")).alias("role_label"),
            F.when(n % 2 == 0, F.concat(F.when(n % 4 == 0, F.lit(" ")).otherwise(F.lit("")),
                                        F.lit("emp."), ns, F.lit("@gmail.com")))
             .otherwise(F.concat(F.lit("emp"), ns, F.lit("@mail.example"))).alias("contact"),
            F.when(n % 10 == 0, _lit_null("long")).otherwise(n % N_WAREHOUSES).alias("warehouse_id"),
            (F.lit(1000) + (n % 7) * 250).cast(MONEY).alias("monthly_salary")))

    @cached_property
    def employee(self) -> DataFrame:
        """Stored employees: the staged rows with a stored role taken round-robin
        from the role domain (no intake logic is applied here)."""
        from stockflow.schemas import DOMAINS
        roles = DOMAINS[("employee", "role")]
        e = self.employee_intake
        return e.select("emp_id", "name",
                        F.element_at(F.array(*[F.lit(r) for r in roles]),
                                     (F.col("emp_id") % len(roles) + 1).cast("int")).alias("role"),
                        "contact", "warehouse_id", "monthly_salary")

    # ---- orders ------------------------------------------------------
    def _lines(self, status: str) -> DataFrame:
        return self.raw("lineitem").where(F.col("l_linestatus") == status)

    @cached_property
    def purchase_order(self) -> DataFrame:
        heads = (self._lines("O").groupBy("l_orderkey")
                 .agg(F.min("l_suppkey").alias("supplier_id"), F.min("l_shipdate").alias("first_ship")))
        o = self.raw("orders")
        k = F.col("l_orderkey")
        st = (F.when(F.col("o_orderstatus") == "F", "RECEIVED")
              .when(F.col("o_orderstatus") == "O", "APPROVED")
              .when(k % 10 == 0, "CANCELLED").otherwise("CREATED"))
        return heads.join(o, heads.l_orderkey == o.o_orderkey).select(
            k.alias("po_id"), "supplier_id", (k % N_WAREHOUSES).alias("warehouse_id"),
            F.col("first_ship").cast("date").alias("po_date"), st.alias("status"),
            F.col("o_totalprice").cast(HEADER_TOTAL).alias("total_amount"))

    @cached_property
    def purchase_order_details(self) -> DataFrame:
        lines = (self._lines("O").groupBy("l_orderkey", "l_partkey")
                 .agg(F.sum("l_quantity").cast("long").alias("quantity")))
        it = self.item.select("item_id", "price")
        return lines.join(it, lines.l_partkey == it.item_id).select(
            (F.col("l_orderkey") * DETAIL_KEY + F.col("l_partkey")).alias("po_detail_id"),
            F.col("l_orderkey").alias("po_id"), "item_id", "quantity", "price")

    @cached_property
    def sales_order(self) -> DataFrame:
        k = F.col("o_orderkey")
        st = (F.when(F.col("o_orderstatus") == "F", "SHIPPED")
              .when(F.col("o_orderstatus") == "O", "CONFIRMED")
              .when(k % 10 == 0, "CANCELLED").otherwise("NEW"))
        return self.raw("orders").select(
            k.alias("so_id"), F.col("o_custkey").alias("customer_id"),
            (k % N_WAREHOUSES).alias("warehouse_id"),
            F.col("o_orderdate").cast("date").alias("so_date"), st.alias("status"),
            F.col("o_totalprice").cast(HEADER_TOTAL).alias("total_amount"))

    @cached_property
    def sales_order_details(self) -> DataFrame:
        lines = (self._lines("F").groupBy("l_orderkey", "l_partkey")
                 .agg(F.sum("l_quantity").cast("long").alias("quantity"),
                      F.max(F.col("l_tax").cast("decimal(4,2)")).alias("tax")))
        it = self.item.select("item_id", F.col("price").alias("list_price"))
        return lines.join(it, lines.l_partkey == it.item_id).select(
            (F.col("l_orderkey") * DETAIL_KEY + F.col("l_partkey")).alias("so_detail_id"),
            F.col("l_orderkey").alias("so_id"), "item_id", "quantity",
            F.round(F.col("list_price") * (F.lit(1) + F.col("tax")), 2).cast(MONEY).alias("price"))

    @cached_property
    def po_intake(self) -> DataFrame:
        """Staged new purchase orders, one per order row; the supplier column
        takes the customer key, so keys beyond the supplier table are unknown."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("staged_id"), F.col("o_custkey").alias("supplier_id"),
            (F.col("o_orderkey") % N_WAREHOUSES).alias("warehouse_id"),
            F.col("o_orderdate").cast("date").alias("po_date"))

    @cached_property
    def so_line_intake(self) -> DataFrame:
        """Staged sales-order lines typed by users: open lineitem rows; the
        price is typed on odd line numbers only."""
        li = self._lines("O")
        return li.select(
            ((F.col("l_orderkey") * DETAIL_KEY + F.col("l_partkey")) * 100 + F.col("l_linenumber")).alias("staged_id"),
            F.col("l_orderkey").alias("so_id"), F.col("l_partkey").alias("item_id"),
            F.col("l_quantity").cast("long").alias("quantity"),
            F.when(F.col("l_linenumber") % 2 == 1,
                   (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("decimal(14,0)")
                    * F.lit(0.01).cast("decimal(3,2)"))).cast(MONEY).alias("price"))

    # ---- stock and movements ----------------------------------------
    @cached_property
    def stock(self) -> DataFrame:
        po = self.purchase_order.where(F.col("status") == "RECEIVED").select("po_id", "warehouse_id", "po_date")
        g = (self.purchase_order_details.join(po, "po_id")
             .groupBy("warehouse_id", "item_id")
             .agg(F.sum("quantity").alias("quantity"), F.max("po_date").alias("last_date")))
        return g.select(
            (F.col("warehouse_id") * 1_000_000_000 + F.col("item_id")).alias("stock_id"),
            "warehouse_id", "item_id", F.col("quantity").cast("long").alias("quantity"),
            F.col("last_date").cast("timestamp").alias("last_updated"))

    @cached_property
    def transaction_log(self) -> DataFrame:
        """Movement ledger from the events table (batch form of the stream)."""
        return movements_from_events(self.raw("events"))

    @cached_property
    def returns(self) -> DataFrame:
        li = self.raw("lineitem")
        kind = (F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), "CUSTOMER")
                .when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), "SUPPLIER"))
        r = (li.withColumn("kind", kind).where(F.col("kind").isNotNull())
             .groupBy("l_orderkey", "l_partkey", "kind")
             .agg(F.sum("l_quantity").cast("long").alias("quantity"),
                  F.min("l_shipdate").alias("returned_at")))
        return r.select(
            ((F.col("l_orderkey") * DETAIL_KEY + F.col("l_partkey")) * 2
             + F.when(F.col("kind") == "SUPPLIER", 1).otherwise(0)).alias("return_id"),
            (F.col("l_orderkey") % N_WAREHOUSES).alias("warehouse_id"),
            F.col("l_partkey").alias("item_id"), "kind", "quantity",
            F.col("returned_at").cast("timestamp").alias("returned_at"))

    @cached_property
    def reorder_alerts(self) -> DataFrame:
        """Existing alerts on the movement keys, covering every status mix."""
        keys = self.transaction_log.select("warehouse_id", "item_id").distinct()
        keys = keys.join(self.item.select("item_id", "reorder_level"), "item_id")
        m = F.col("item_id") % 4

        def row(cond, status, code, date):
            return F.when(cond, F.struct(
                ((F.col("warehouse_id") * 1000 + F.col("item_id")) * 4 + code).alias("alert_id"),
                "warehouse_id", "item_id", F.lit(0).cast("long").alias("current_quantity"),
                "reorder_level", _lit_null("long").alias("expected_quantity"),
                F.lit(date).cast("timestamp").alias("alert_date"), F.lit(status).alias("status")))

        return keys.select(F.inline(F.array_compact(F.array(  # the ledger is scanned once
            row((m == 1) | (m == 3) | ((m == 0) & (F.col("warehouse_id") % 2 == 0)), "OPEN", 1, "2023-12-01 00:00:00"),
            row((m == 2) | (m == 3), "ACK", 2, "2023-12-15 00:00:00"),
            row((m == 0) & (F.col("warehouse_id") % 2 == 0), "RESOLVED", 3, "2023-11-01 00:00:00")))))


def movements_from_events(events: DataFrame) -> DataFrame:
    """Map event rows onto ledger rows (stand-in movements)."""
    q = F.floor(F.col("value")).cast("long")
    et = F.col("event_type")
    ct = (F.when(et.isin("purchase", "signup"), "IN")
          .when(et.isin("view", "click"), "OUT")
          .when(et == "error", "ADJUST"))
    odd = F.col("event_id") % 2 == 1
    return (events.select(
        F.col("event_id").alias("log_id"),
        (F.col("user_id") % N_WAREHOUSES).alias("warehouse_id"),
        (F.get_json_object("props", "$.k").cast("long") % EVENT_ITEMS).alias("item_id"),
        ct.alias("change_type"),
        F.when((ct != "IN") & odd, -q).otherwise(q).alias("delta_qty"),
        F.when(ct == "IN", "PO").when(ct == "OUT", "SO").otherwise("MANUAL").alias("ref_type"),
        F.when(ct == "ADJUST", _lit_null("long")).otherwise(F.col("event_id")).alias("ref_id"),
        F.col("user_id").alias("emp_id"),
        F.col("ts").cast("timestamp").alias("logged_at"))
        .where((F.col("delta_qty") != 0) & F.col("change_type").isNotNull()))
