"""Clipped fold across chunks: step tables against a row-by-row fold."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stockflow.plans import scan

KEYS = ["w", "i"]


def naive(values, b=0):
    out = []
    for v in values:
        ok = b + v >= 0
        b += v if ok else 0
        out.append((b, ok))
    return out


def table(spark, keys):
    rows = [(1, k, t, v, False) for k, values in keys.items() for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "w long, i long, t long, v long, r boolean")


def folded(df, **kw):
    stats = {}
    out = scan.clipped_fold(df, KEYS, ["t"], "v", "r", stats=stats, **kw).orderBy("i", "t").collect()
    got = {}
    for x in out:
        got.setdefault(x.i, []).append((x.balance, x.accepted))
    return got, stats


def near_zero(seed, n, big=4):
    r = random.Random(seed)
    return [r.randint(-big, big - 1) for _ in range(n)]


def test_hot_key_near_zero_never_leaves_its_chunks(spark, monkeypatch):
    """32 chunks, no row is streamed; the tables' plan moves no row, and one chunk's rows meet in a task."""
    keys = {1: near_zero(1, 4000), 2: near_zero(2, 2500, 40), 3: [5]}
    seen = {}
    tables = scan._step_tables

    def kept(slim, *a):
        seen["tables"] = tables(slim, *a)
        seen["sizes"] = [r[0] for r in slim.groupBy(scan.PID).count().select("count").collect()]
        return seen["tables"]

    monkeypatch.setattr(scan, "_step_tables", kept)
    monkeypatch.setattr(scan, "_stream_chains", lambda *a: pytest.fail("rows were streamed"))
    got, stats = folded(table(spark, keys), num_partitions=32)
    assert got == {k: naive(v) for k, v in keys.items()}
    assert stats["tabled_keys"] == 2 and stats["streamed_keys"] == 0 and stats["passes"] == 4
    plan = seen["tables"]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert max(seen["sizes"]) < 3 * sum(seen["sizes"]) / len(seen["sizes"])
    rows = seen["tables"].collect()
    assert all(len(r["table"]) <= 8 * min(r["_high"] + 1, r["_need"]) for r in rows)
    assert max(len(r["table"]) for r in rows) < 8 * 2000  # the bound on entry balances keeps tables small


def test_a_table_beyond_its_size_streams_that_key_only(spark):
    keys = {1: [900] + near_zero(3, 600) + [-800, -90, 3, -60, -40] * 30, 2: near_zero(4, 500, 3)}
    got, stats = folded(table(spark, keys), num_partitions=16, table_entries=40)
    assert got == {k: naive(v) for k, v in keys.items()}
    assert stats["streamed_keys"] == 1 and stats["tabled_keys"] == 1


@pytest.mark.parametrize("seed", range(3))
def test_many_keys_and_chunks(spark, seed):
    r = random.Random(seed)
    keys = {k: [r.randint(-9, 8) * r.choice([1, 1, 1, 30]) for _ in range(r.choice([1, 5, 200]))] for k in range(12)}
    got, _ = folded(table(spark, keys), num_partitions=24, table_entries=r.choice([3, 1 << 16]))
    assert got == {k: naive(v) for k, v in keys.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-12, 12), max_size=90), st.integers(0, 60))
def test_exits_of_every_entry(values, most):
    got = scan._exits(np.array(values, np.int64), np.arange(most + 1))
    assert got.tolist() == [naive(values, b)[-1][0] if values else b for b in range(most + 1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(-12, 12), min_size=1, max_size=20), min_size=1, max_size=4), st.integers(0, 60))
def test_bound_on_the_exit_balance(parts, entry):
    run = scan._Run((1,), True)
    for p in parts:
        run.add(np.array(p, np.int64), np.zeros(len(p), bool))
    bound = max(entry + run.total, run.draw - 1 + run.gain, 0)
    assert all(naive(sum(parts, []), b)[-1][0] <= bound for b in range(entry + 1))
