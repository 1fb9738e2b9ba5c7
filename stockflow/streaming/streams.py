"""Structured Streaming forms of the stock triggers (ST1-ST6).

* ``stream_stock`` / ``stream_totals`` / ``stream_monthly``: update-mode
  aggregations. Sums are order-free, so late rows are simply added; state is
  one row per key.
* ``dedupe_movements``: watermark + ``dropDuplicatesWithinWatermark`` so a
  replayed receipt or shipment is applied once.
* ``SnapshotSink``: ``foreachBatch`` sink whose state lies in buckets of keys.
  A micro-batch rewrites the buckets that hold its keys, copy on write, and then
  publishes a manifest that names the version of every bucket. Both are
  idempotent, so a retried batch is harmless, and readers always see a whole
  version.
* ``InventoryPipeline``: live stock *and* alerts. Each micro-batch runs the
  batch operators (clipped fold, observations, alert maintenance) on the
  previous snapshots -- the same skew-safe plans as batch, so one hot key is
  never one task. Batches apply in arrival order; rows inside a batch in
  event-time order (the trigger semantics are order dependent; this is the
  rule the database applied too: commit order).
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stockflow.functions.scalars import line_total, month_key, signed_qty
from stockflow.plans.checkpoint import checkpoint_dir, ensure_checkpoint_dir

KEY = ["warehouse_id", "item_id"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (required)."""
    base = checkpoint_dir(spark) or ensure_checkpoint_dir(spark)  # raises on a cluster without one
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def stage_files(df: DataFrame, path: str, n_steps: int, order: list[str], rows_per_file: int = 1_000_000) -> int:
    """Write ``df`` to ``path`` in ``n_steps`` steps, each a later ``order``
    range than the one before, and return the files per step.

    A step is written by as many tasks as its rows need, about
    ``rows_per_file`` each; a reader that takes that many files per trigger
    (the file source takes files oldest first) replays step after step.
    """
    spark, aside = df.sparkSession, path + "-steps"
    (df.repartitionByRange(n_steps * 4, *order).withColumn("_step", F.floor(F.spark_partition_id() / 4).cast("int"))
     .write.partitionBy("_step").parquet(aside))   # each step is read back alone
    steps = spark.read.schema(StructType(df.schema.fields + [StructField("_step", IntegerType())])).parquet(aside)
    files = max(1, -(-steps.count() // (n_steps * rows_per_file)))
    for k in range(n_steps):
        steps.where(F.col("_step") == k).drop("_step").repartition(files).write.mode("append").parquet(path)
    return files


def read_stream(spark: SparkSession, path: str, schema: StructType,
                max_files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


# ---------------------------------------------------------------- aggregations
def stream_stock(moves: DataFrame) -> DataFrame:
    """ST1: net stock change per (warehouse, item) from a movement stream."""
    m = moves if "signed_qty" in moves.columns else moves.withColumn("signed_qty", signed_qty())
    return m.groupBy(*KEY).agg(F.sum("signed_qty").cast("long").alias("net_qty"))


def stream_totals(lines: DataFrame, key: str, out: str = "total") -> DataFrame:
    """ST3: order totals from a stream of line rows (signed change rows carry
    negative quantities for removed lines)."""
    return lines.groupBy(key).agg(F.sum(line_total()).cast("decimal(18,2)").alias(out))


def stream_monthly(lines: DataFrame, date_col: str, out: str) -> DataFrame:
    """ST6: running monthly totals (calendar months: ``window()`` cannot do
    month lengths, so group on the month key)."""
    return (lines.groupBy(month_key(date_col).alias("month"))
            .agg(F.sum(line_total()).cast("decimal(38,2)").alias(out)))


def signed_lines(changes: DataFrame) -> DataFrame:
    """ST3: changes of order lines as signed lines. A change has ``before`` and
    ``after`` (structs of the line's columns): an insert has no before, a
    delete no after, an update both. What was there is retracted: it comes
    back with its quantity negated, so sums over the result follow every change
    whatever order the changes come in."""
    fields = [f.name for f in changes.schema["after"].dataType.fields]
    old = F.struct(*[(-F.col("before.quantity") if c == "quantity" else F.col("before." + c)).alias(c) for c in fields])
    signed = F.array(F.when(F.col("before").isNotNull(), old), F.when(F.col("after").isNotNull(), F.col("after")))
    return changes.select(F.explode(F.array_compact(signed)).alias("_l")).select(*[F.col("_l." + c).alias(c) for c in fields])


def stream_pnl(purchases: DataFrame, sales: DataFrame, date_col: str) -> DataFrame:
    """ST6: running purchases, sales and profit or loss by month from two
    streams of order lines, in one stateful aggregate (no join of streams, so
    a month that has only one kind is there from its first line)."""
    money, zero = "decimal(38,2)", F.lit(0).cast("decimal(38,2)")
    both = (purchases.select(date_col, line_total().cast(money).alias("_p"), zero.alias("_s"))
            .unionByName(sales.select(date_col, zero.alias("_p"), line_total().cast(money).alias("_s"))))
    t = both.groupBy(month_key(date_col).alias("month")).agg(F.sum("_p").cast(money).alias("total_purchases"),
                                                             F.sum("_s").cast(money).alias("total_sales"))
    return t.select("month", "total_purchases", "total_sales", zero.alias("salaries"),
                    (F.col("total_sales") - F.col("total_purchases")).cast(money).alias("profit_loss"))


def movement_identity() -> "F.Column":
    """What makes two ledger rows the same movement: an order line for
    receipts/shipments (ref_type, ref_id, item_id) -- a re-sent receipt gets a
    new log id but is the same movement -- and the log id otherwise."""
    return (F.when(F.col("ref_type").isin("PO", "SO") & F.col("ref_id").isNotNull(),
                   F.concat_ws(":", F.col("ref_type"), F.col("ref_id").cast("string"),
                               F.col("item_id").cast("string")))
            .otherwise(F.concat(F.lit("log:"), F.col("log_id").cast("string"))))


def dedupe_movements(moves: DataFrame, delay: str, keys: list[str] | None = None,
                     time_col: str = "logged_at") -> DataFrame:
    """ST4: drop replayed movements arriving within ``delay`` of the first
    copy. Identity is ``keys`` if given, else ``movement_identity()``."""
    if keys is None:
        m = moves.withColumn("_movement", movement_identity())
        return (m.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["_movement"])
                .drop("_movement"))
    return moves.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


# ---------------------------------------------------------------- snapshot sink
def committed_versions(spark: SparkSession, base: str) -> list[int]:
    """Epochs whose snapshot folder ``<base>/v=<epoch>`` is complete, found by
    listing the folder; any failure to list is raised."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name[2:]))
    return sorted(found)


class SnapshotSink:
    """``foreachBatch`` sink keeping a keyed state in bucketed, versioned files.

    A row's bucket is a hash of its ``keys``. ``<base>/data/v=<epoch>/_bucket=<b>``
    holds what an epoch wrote, ``<base>/manifest/v=<epoch>`` names, for every
    bucket that has rows, the epoch whose files are current. A batch reads and
    rewrites only the buckets of its own keys; then its manifest, written aside
    and renamed, takes effect in one step. So its cost follows the keys that it
    touches, not the state. ``buckets`` (by default the shuffle partitions of
    the session that creates the state; the manifest keeps the number) bounds
    both the manifest and what one task writes: choose it so that a bucket of
    the state fits a task.

    ``merge(previous, batch_df, epoch)`` gives the new rows of the touched
    buckets from their old ones. The previous state is the newest manifest
    strictly below the epoch, found by listing and never from memory, so an
    epoch that is run again -- by this object or by a new one after a restart --
    starts from the same state and writes the same version. Epoch 0 starts from
    ``initial``; a later epoch without an earlier version is an error, not a
    fresh start. After each epoch, files that the last ``keep`` manifests no
    longer name are removed (at least two, so that the last epoch can run again).
    """

    INITIAL = -1

    def __init__(self, spark: SparkSession, base: str, merge, initial: DataFrame, keys: list[str],
                 buckets: int | None = None, keep: int = 2):
        self.spark, self.base, self.merge, self.initial = spark, base, merge, initial
        self.keys, self.keep = keys, max(keep, 2)
        found = self.versions()
        self.buckets = (self._content(found[-1])["buckets"] if found
                        else buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

    # -- layout
    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Epochs with a manifest; any failure to list is raised."""
        path, fs = self._path("manifest")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def _content(self, version: int) -> dict:
        path, fs = self._path("manifest", f"v={version}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int) -> dict[int, int]:
        """Bucket -> epoch whose files hold it."""
        return {int(b): v for b, v in self._content(version)["epochs"].items()}

    def _publish(self, version: int, manifest: dict[int, int]) -> None:
        folder, fs = self._path("manifest")
        fs.mkdirs(folder)
        aside, _ = self._path("manifest", f"_{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "epochs": manifest}, sort_keys=True).encode()))
        out.close()
        jvm, (final, _) = self.spark._jvm, self._path("manifest", f"v={version}")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(
            fs.makeQualified(aside), fs.makeQualified(final), options)

    # -- reading
    def _read(self, manifest: dict[int, int], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.base}/data/v={v}/_bucket={b}" for b, v in sorted(manifest.items()) if only is None or b in only]
        if not paths:
            return self.initial.limit(0)
        return self.spark.read.schema(self.initial.schema).parquet(*paths)

    def _before(self, epoch: int) -> dict[int, int]:
        earlier = [v for v in self.versions() if v < epoch]
        if not earlier and epoch > 0:
            raise RuntimeError(f"{self.base} holds no version before epoch {epoch}; its state is lost")
        if not earlier:
            self._write(self.INITIAL, self.initial, set(range(self.buckets)), {})
            earlier = [self.INITIAL]
        return self.manifest(earlier[-1])

    def previous(self, epoch: int, touched: set[int] | None = None) -> DataFrame:
        """The state before an epoch, or its ``touched`` buckets only."""
        return self._read(self._before(epoch), touched)

    def current(self) -> DataFrame:
        found = self.versions()
        return self._read(self.manifest(found[-1])) if found else self.initial

    # -- writing
    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets of some rows: at most ``buckets`` numbers."""
        return {r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()}

    def _write(self, version: int, rows: DataFrame, touched: set[int], before: dict[int, int]) -> None:
        folder, fs = self._path("data", f"v={version}")
        (rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite")
         .partitionBy("_bucket").parquet(folder.toString()))
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        written = {int(n.partition("=")[2]) for n in names if n.startswith("_bucket=")}
        if not written <= touched:
            raise RuntimeError(f"epoch {version} gave rows of buckets that its batch does not touch")
        self._publish(version, {b: v for b, v in before.items() if b not in touched} | {b: version for b in written})

    def commit(self, epoch: int, rows: DataFrame, touched: set[int]) -> None:
        """Publish ``rows`` as the new content of the touched buckets."""
        self._write(epoch, rows, touched, self._before(epoch))
        self.expire(epoch)

    def expire(self, epoch: int) -> None:
        """Remove what the last ``keep`` manifests up to ``epoch`` do not name."""
        versions = [v for v in self.versions() if v <= epoch]
        kept = {(b, v) for m in versions[-self.keep:] for b, v in self.manifest(m).items()}
        for old in versions[:-self.keep]:
            for b, v in self.manifest(old).items():
                if (b, v) not in kept:
                    path, fs = self._path("data", f"v={v}", f"_bucket={b}")
                    fs.delete(path, True)
            path, fs = self._path("manifest", f"v={old}")
            fs.delete(path, False)

    def __call__(self, batch_df: DataFrame, epoch: int) -> None:
        batch_df = batch_df.persist()  # read for its buckets and for its rows
        try:
            touched = self.touched(batch_df)
            self.commit(epoch, self.merge(self.previous(epoch, touched), batch_df, epoch), touched)
        finally:
            batch_df.unpersist()


def merge_keyed(keys: list[str]):
    """Merge rule for update-mode aggregates: changed keys replace old rows."""
    def merge(prev: DataFrame, batch: DataFrame, epoch: int) -> DataFrame:
        return prev.join(batch.select(*keys), keys, "left_anti").unionByName(batch.select(*prev.columns))
    return merge


def run_available_now(writer, checkpoint: str):
    """Run a streaming write over everything available, then stop."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q


def aggregate_to_snapshots(agg: DataFrame, keys: list[str], initial: DataFrame, base: str) -> SnapshotSink:
    """ST5: maintain a keyed aggregate as versioned snapshots."""
    spark = agg.sparkSession
    sink = SnapshotSink(spark, base, merge_keyed(keys), initial, keys)
    run_available_now(agg.writeStream.outputMode("update").foreachBatch(sink), base + "/_checkpoint")
    return sink


# ---------------------------------------------------------------- live stock + alerts
class InventoryPipeline:
    """ST2 + ST5: live stock and reorder alerts from a movement stream.

    State is two snapshot tables (stock with each key's last applied event
    time, and alerts) versioned by epoch. Each micro-batch:

    1. late rule -- a movement older than the last one already applied for
       its key would change history the alerts were built on; it is written
       to ``<base>/late/v=<epoch>`` instead of being applied (the reference
       sets no rule; this keeps every key's history in event-time order);
    2. clipped fold of the remaining movements from the current stock
       (moves that would go negative are rejected);
    3. one observation per applied movement, alert maintenance;
    4. both tables publish a new version of the batch's buckets (replay-safe).

    Stock and alerts have the same keys and so the same buckets: a batch reads
    and writes the buckets of its own keys and no others.
    """

    def __init__(self, spark: SparkSession, base: str, stock: DataFrame, alerts: DataFrame,
                 item: DataFrame, new_alert_id_offset: int = 0):
        self.spark, self.base = spark, base
        self.item, self.offset = item, new_alert_id_offset
        init = stock.select(*KEY, "quantity", F.lit(None).cast("timestamp").alias("last_logged_at"))
        self.stock_sink = SnapshotSink(spark, base + "/stock", None, init, KEY)
        self.alert_sink = SnapshotSink(spark, base + "/alerts", None, alerts, KEY)

    def __call__(self, batch_df: DataFrame, epoch: int) -> None:
        batch_df = batch_df.persist()
        try:
            self._apply(batch_df, epoch)
        finally:
            batch_df.unpersist()

    def _apply(self, batch_df: DataFrame, epoch: int) -> None:
        from stockflow.operators import alerts as alerts_op
        from stockflow.operators import ledger
        touched = self.stock_sink.touched(batch_df)
        stock = self.stock_sink.previous(epoch, touched)
        alerts = self.alert_sink.previous(epoch, touched)
        marks = stock.where(F.col("last_logged_at").isNotNull()).select(*KEY, F.col("last_logged_at").alias("_mark"))
        tagged = batch_df.join(marks, KEY, "left")
        late = F.col("_mark").isNotNull() & (F.col("logged_at") < F.col("_mark"))
        tagged.where(late).drop("_mark").write.mode("overwrite").parquet(f"{self.base}/late/v={epoch:08d}")
        moves = tagged.where(~late).drop("_mark")
        applied = ledger.apply_movements(alerts_op.with_levels(moves, self.item), stock.select(*KEY, "quantity"))
        new_stock = ledger.stock_after(stock, applied, "last_logged_at").select(*KEY, "quantity", "last_logged_at")
        obs = alerts_op.observations(applied, id_offset=self.offset)
        new_alerts = alerts_op.maintain_alerts(alerts, obs, in_order=True)
        self.stock_sink.commit(epoch, new_stock, touched)
        self.alert_sink.commit(epoch, new_alerts, touched)

    def run(self, moves: DataFrame) -> "InventoryPipeline":
        run_available_now(moves.writeStream.foreachBatch(self), self.base + "/_checkpoint")
        return self

    def stock(self) -> DataFrame:
        return self.stock_sink.current().select(*KEY, "quantity")

    def alerts(self) -> DataFrame:
        return self.alert_sink.current()

    def late(self) -> DataFrame | None:
        """Movements that came too late to apply; None before the first batch."""
        base = f"{self.base}/late"
        return self.spark.read.parquet(base) if committed_versions(self.spark, base) else None
