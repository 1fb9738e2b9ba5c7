"""Snapshots survive replays: the same epoch again changes nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockflow.schemas import SCHEMAS
from stockflow.streaming import streams


def batch(spark, day, rows):
    at = dt.datetime(2025, 1, day)
    return spark.createDataFrame([(10 * day + k, 1, i, kind, q, "MANUAL", None, None, at)
                                  for k, (i, kind, q) in enumerate(rows)], SCHEMAS["transaction_log"])


def pipeline(spark, base, seed):
    return streams.InventoryPipeline(spark, base, seed["stock"], seed["reorder_alerts"], seed["item"], 1000)


def state(p):
    return (sorted(map(tuple, p.stock().collect())), sorted(map(str, p.alerts().collect())))


def test_replayed_epochs_change_nothing(spark, seed, tmp_path):
    base = str(tmp_path / "live")
    first = batch(spark, 2, [(1, "IN", 5), (2, "OUT", 1)])
    second = batch(spark, 3, [(1, "IN", 5), (3, "OUT", 2)])
    p = pipeline(spark, base, seed)
    p(first, 0)
    p(second, 1)
    want = state(p)
    p(second, 1)                                   # the same object
    assert state(p) == want
    pipeline(spark, base, seed)(second, 1)         # a new one, after a restart
    assert state(p) == want
    # a failure between the two writes: the stock of epoch 2 is there, its alerts are not
    third = batch(spark, 4, [(2, "OUT", 4)])
    after = pipeline(spark, base, seed)
    touched = after.stock_sink.touched(third)
    after.stock_sink.commit(2, after.stock_sink.previous(2, touched).withColumn("quantity", F.col("quantity") + 99), touched)
    after(third, 2)
    q1 = {k[:2]: k[2] for k in want[0]}
    q2 = {k[:2]: k[2] for k in state(after)[0]}
    assert q2[(1, 2)] == q1[(1, 2)] - 4 and all(q2[k] == v for k, v in q1.items() if k != (1, 2))


def test_a_lost_state_is_an_error(spark, seed, tmp_path):
    p = pipeline(spark, str(tmp_path / "gone"), seed)
    with pytest.raises(RuntimeError, match="no version before epoch 7"):
        p(batch(spark, 2, [(1, "IN", 1)]), 7)
    assert p.late() is None


def test_half_written_version_does_not_count(spark, tmp_path):
    base = str(tmp_path / "s")
    spark.range(3).write.parquet(f"{base}/v=00000000")
    (tmp_path / "s" / "v=00000001").mkdir()
    assert streams.committed_versions(spark, base) == [0]


def files(base):
    return {str(p.relative_to(base)): p.stat().st_mtime_ns for p in base.rglob("*.parquet")}


def counter(spark, base, n=1000, **kw):
    start = spark.range(n).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v"))
    return streams.SnapshotSink(spark, str(base), streams.merge_keyed(["k"]), start, ["k"], **kw)


def test_one_key_rewrites_one_bucket(spark, tmp_path):
    sink = counter(spark, tmp_path / "c", buckets=16, keep=10)
    one = spark.createDataFrame([(7, 1)], "k long, v long")
    sink(one, 0)
    before = files(tmp_path / "c")
    sink(spark.createDataFrame([(7, 2)], "k long, v long"), 1)
    after = files(tmp_path / "c")
    assert before.items() <= after.items()                 # nothing that was there is written again
    assert len({f.split("/")[2] for f in after.keys() - before.keys()}) == 1
    m0, m1 = sink.manifest(0), sink.manifest(1)
    assert sum(m0[b] != m1[b] for b in m0) == 1 and len(m1) == 16
    assert {r.k: r.v for r in sink.current().collect()} == {k: 2 if k == 7 else 0 for k in range(1000)}
    plan = sink.previous(2, sink.touched(one)).inputFiles()
    assert all(f"_bucket={next(iter(sink.touched(one)))}/" in f for f in plan)


def test_old_versions_are_removed_and_the_last_epoch_runs_again(spark, tmp_path):
    sink = counter(spark, tmp_path / "c", 100, buckets=4)
    batches = [spark.createDataFrame([(k, e + 1) for k in range(e, 60)], "k long, v long") for e in range(5)]
    for e, b in enumerate(batches):
        sink(b, e)
    want = sorted(map(tuple, sink.current().collect()))
    assert sink.versions() == [3, 4]
    named = {f"data/v={v}/_bucket={b}" for m in (3, 4) for b, v in sink.manifest(m).items()}
    assert {f.rsplit("/", 1)[0] for f in files(tmp_path / "c")} == named
    counter(spark, tmp_path / "c", 100, buckets=4)(batches[4], 4)
    assert sorted(map(tuple, sink.current().collect())) == want
    assert want == sorted((k, 0 if k >= 60 else min(k, 4) + 1) for k in range(100))


def test_a_bucket_can_become_empty(spark, tmp_path):
    def drop(prev, batch, epoch):
        return prev.join(batch, "k", "left_anti")
    sink = streams.SnapshotSink(spark, str(tmp_path / "e"), drop, spark.createDataFrame([(1, 1), (2, 2)], "k long, v long"), ["k"], 64)
    sink(spark.createDataFrame([(1,)], "k long"), 0)
    assert [tuple(r) for r in sink.current().collect()] == [(2, 2)]
    sink(spark.createDataFrame([(2,)], "k long"), 1)
    assert sink.current().count() == 0
    sink(spark.createDataFrame([], "k long"), 2)
    assert sink.versions() == [1, 2] and sink.current().count() == 0


def test_changes_are_signed(spark):
    kind = "before struct<o:long,quantity:long,price:int>, after struct<o:long,quantity:long,price:int>"
    rows = [(None, (1, 5, 2)), ((1, 5, 2), (1, 7, 2)), ((1, 7, 2), (2, 7, 3)), ((2, 7, 3), None), (None, (3, 1, 1))]
    signed = streams.signed_lines(spark.createDataFrame(rows, kind))
    assert {r.o: r.total for r in streams.stream_totals(signed, "o").collect()} == {1: 0, 2: 0, 3: 1}
