"""Shipping allocation in bounded rounds, by every way of deciding."""

import random

import pytest

from stockflow.operators.allocation import allocate
from stockflow.plans.components import components

LINES = "so_id long, warehouse_id long, item_id long, quantity long"
STOCK = "warehouse_id long, item_id long, quantity long"


def sequential(lines, stock):
    left, by = {(w, i): q for w, i, q in stock}, {}
    for so, w, i, q in lines:
        own = by.setdefault(so, {})
        own[w, i] = own.get((w, i), 0) + q
    out = {}
    for so in sorted(by):
        out[so] = all(left.get(k, 0) >= q for k, q in by[so].items())
        for k, q in by[so].items() if out[so] else ():
            left[k] = left.get(k, 0) - q
    return out


def run(spark, lines, stock, **kw):
    stats = {}
    rows = allocate(spark.createDataFrame(lines, LINES), spark.createDataFrame(stock, STOCK), stats=stats, **kw).collect()
    got = {r.so_id: r.shipped for r in rows}
    assert len(rows) == len(got)
    return got, stats


def chain(n, first=0, item=0):
    """Each order needs the key of the order before it as well, so none can be decided before that."""
    return ([(first + k, 0, item + k + d, 1) for k in range(n) for d in (0, 1)], [(0, item + k, 1) for k in range(n + 1)])


def test_chain_of_1000_orders(spark):
    lines, stock = chain(1000)
    want = sequential(lines, stock)
    got, stats = run(spark, lines, stock)
    assert got == want and stats["rounds"] == 1 and stats["ways"] == ["warehouse"]
    got, stats = run(spark, lines, stock, fold_lines=900)
    assert got == want and stats["rounds"] <= 2 * 2000 / 900 + 1
    assert set(stats["ways"]) == {"sums", "component", "warehouse"}


def test_many_components_take_one_round(spark):
    lines, stock = [], []
    for c in range(12):
        a, b = chain(25, 1000 * c, 100 * c)
        lines, stock = lines + a, stock + b
    got, stats = run(spark, lines, stock, fold_lines=60)
    assert got == sequential(lines, stock)
    assert stats["ways"] == ["sums", "component"]


@pytest.mark.parametrize("seed", range(2))
def test_random_orders_by_every_way(spark, seed):
    r = random.Random(seed)
    lines = [(o, o % 3, i, r.randint(1, 9)) for o in range(120) for i in r.sample(range(12), r.randint(1, 4))]
    lines += [(o, o % 3, r.randrange(12), 2) for o in range(0, 120, 7)]  # a second line of one item
    stock = [(w, i, r.randint(0, 60)) for w in range(3) for i in range(12) if r.random() < 0.9]
    want = sequential(lines, stock)
    for fold_lines in (10**6, 40):
        got, stats = run(spark, lines, stock, fold_lines=fold_lines)
        assert got == want
        assert stats["undecided"] == sorted(stats["undecided"], reverse=True)


def test_two_lines_of_one_item_count_together(spark):
    got, _ = run(spark, [(1, 0, 5, 6), (1, 0, 5, 6), (2, 0, 5, 6)], [(0, 5, 10)], fold_lines=1)
    assert got == {1: False, 2: True}


def test_no_lines(spark):
    assert run(spark, [], [(0, 1, 5)])[0] == {}


def test_components_against_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000 + k) for k in range(300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {n: find(n) for e in edges for n in e}
    alone = {n for n in want if all(a == b for a, b in edges if n in (a, b))}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.root for x in got} == {n: m for n, m in want.items() if n not in alone}
    assert len(got) == len({x.node for x in got})
