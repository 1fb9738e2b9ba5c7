"""SimHash near-duplicates (operator 7) linked through vantage-point trees.

Every whole text becomes a 64-bit fingerprint: a bit is set when more than
half of the 3-word shingles' XXH64 values have it. Equal fingerprints are
folded into one node first. A vantage-point tree over a bounded sample deals
the nodes into shards by Hamming distance. A node near a shard's boundary
(within ``max_bits`` of a vantage point's radius) also visits the shards
beyond. Of two shards a hash of both numbers says which one's nodes visit the
other, so each pair across shards meets once and every shard gets about as many
visits. A shard whose visitors are many (by the sample) is held by several tasks,
each with all of its owners and a share of the visitors.
Inside a shard a second vantage-point tree answers the range queries of
owners and visitors, pruned by the triangle inequality, which loses no pair.
A shard returns a spanning forest of its links, not the links; components
follow by star contraction.

Null and empty texts have fingerprint zero and link like any other. Rows
without doc_id are linked too, but never give a component its id (it is null
if no member has one). Repeated rows share fingerprint and component. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from stockflow.llm.common import join_hot_key, materialize
from stockflow.llm.components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Points in a leaf of a shard's tree; sampled points for each shard of the top tree.
LEAF, SAMPLE_PER_SHARD = 64, 64
#: Visitors a task takes, in owners of the mean shard.
VISITORS_MOST = 4
#: Shingles hashed at once, and cells of a distance block.
BLOCK, CELLS = 1 << 16, 1 << 19


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of one whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[:len(words) - k + 1].tolist()
    stops = (ends[k - 1:] - 1).tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + BLOCK], stops[at:at + BLOCK])],
                     dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _vantage(points: np.ndarray) -> tuple[np.uint64, np.ndarray, int] | None:
    """Of a few candidates the point whose distances spread most, with all
    distances to it and their median; None when no candidate splits the points."""
    probe = points[:: max(1, points.size // 256)]
    tried = points[np.linspace(0, points.size - 1, 12).astype(int)]
    for v in tried[np.argsort([-_distance(probe, t).var() for t in tried], kind="stable")]:
        d = _distance(points, v)
        mid = int(np.sort(d)[(d.size - 1) // 2])
        mid -= mid == d.max()
        if (d <= mid).any():
            return v, d, mid
    return None


def build_tree(points: np.ndarray, index: np.ndarray, leaf: int, depth: int = 64):
    """A nested vantage-point tree: (vantage, radius, inner, outer) or an index array."""
    cut = _vantage(points[index]) if index.size > leaf and depth else None
    if cut is None:
        return index
    v, d, mid = cut
    return (v, mid, build_tree(points, index[d <= mid], leaf, depth - 1),
            build_tree(points, index[d > mid], leaf, depth - 1))


def range_pairs(tree, points: np.ndarray, queries: np.ndarray, own: np.ndarray,
                bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query index, point index) within ``bits``; exact."""
    if not own.size:
        return
    if isinstance(tree, tuple):
        v, mid, inner, outer = tree
        d = _distance(queries[own], v)
        yield from range_pairs(inner, points, queries, own[d - bits <= mid], bits)
        yield from range_pairs(outer, points, queries, own[d + bits > mid], bits)
        return
    step = max(1, CELLS // max(1, tree.size))
    for at in range(0, own.size, step):
        q = own[at:at + step]
        i, j = np.nonzero(_distance(queries[q][:, None], points[tree][None, :]) <= bits)
        if i.size:
            yield q[i], tree[j]


class Forest:
    """Union-find over n items that reports each link that joins two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while (up := self.parent[r]).tolist() != r.tolist():
            r = up
        self.parent[i] = r
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Join each a to its b; returns which of the pairs were needed."""
        pairs, at = np.unique(np.stack([self.root(a), self.root(b)], 1), axis=0, return_index=True)
        made, parent = [], self.parent
        for x, y, k in np.column_stack([pairs, at])[pairs[:, 0] != pairs[:, 1]].tolist():
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                made.append(k)
        return made


def _top_tree(sample: np.ndarray, shards: int):
    """The shard tree over the sample, leaves numbered from 0 in order."""
    depth, number = max(0, math.ceil(math.log2(max(shards, 1)))), iter(range(1 << 62))

    def numbered(t):
        return (*t[:2], numbered(t[2]), numbered(t[3])) if isinstance(t, tuple) else next(number)

    return numbered(build_tree(sample, np.arange(sample.size), 1, depth))


def _deal(tree, points: np.ndarray, own: np.ndarray, home: np.ndarray, bits: int,
          out: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """Append (shard, points that reach it, whether it is their home)."""
    if not own.size:
        return
    if not isinstance(tree, tuple):
        out.append((tree, own, home))
        return
    v, mid, inner, outer = tree
    d = _distance(points[own], v)
    a, b = d - bits <= mid, d + bits > mid
    _deal(inner, points, own[a], home[a] & (d[a] <= mid), bits, out)
    _deal(outer, points, own[b], home[b] & (d[b] > mid), bits, out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of each 64-bit number."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _visits(own: np.ndarray, shard: int) -> np.ndarray:
    """Whether nodes of shards ``own`` visit ``shard``; of any two shards one visits the other."""
    low, high = np.minimum(own, shard), np.maximum(own, shard)
    up = _mixed(low.astype(np.uint64) << np.uint64(32) | high.astype(np.uint64)) & np.uint64(1) == 1
    return np.where(own < shard, up, ~up) & (own != shard)


def _placed(tree, p: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, its own points, points that visit it)."""
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    _deal(tree, p, np.arange(p.size), np.ones(p.size, bool), bits, out)
    at = np.zeros(p.size, np.int64)
    for shard, own, home in out:
        at[own[home]] = shard
    for shard, own, home in out:
        yield shard, p[own[home]], p[own[~home & _visits(at[own], shard)]]


def _task_plan(tree, sample: np.ndarray, shards: int, bits: int) -> list[tuple[int, int]]:
    """(first task, tasks) of each shard, as the sample's visits suggest: results do not depend on it."""
    plan, at = [(k, 1) for k in range(shards)], 0
    visitors = {shard: v.size for shard, _, v in _placed(tree, sample, bits)}
    for shard in range(shards):
        tasks = 1 + visitors.get(shard, 0) * shards // (VISITORS_MOST * max(1, sample.size))
        plan[shard] = (at, tasks)
        at += tasks
    return plan


def _dealer(tree, plan: list[tuple[int, int]], bits: int):
    """Rows of (task, visits, fp): each node in its home's tasks and in one task of each shard it visits."""
    def rows(task, visits: bool, p: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"task": np.int32(task) if np.isscalar(task) else task.astype(np.int32),
                             "visits": np.full(p.size, visits), "fp": p.view(np.int64)})

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, owners, visitors in _placed(tree, b["fp"].to_numpy().view(np.uint64), bits):
                first, tasks = plan[shard]
                for task in range(first, first + tasks):
                    yield rows(task, False, owners)
                yield rows(first + (_mixed(visitors) % np.uint64(tasks)).astype(np.int64), True, visitors)
    return deal


def _linker(bits: int):
    def close(owners: list[np.ndarray]):
        points = np.concatenate(owners)
        tree, forest = build_tree(points, np.arange(points.size), LEAF), Forest(points.size)
        made = [np.zeros((0, 2), np.uint64)]
        for q, i in range_pairs(tree, points, points, np.arange(points.size), bits):
            need = forest.link(q, i)
            made.append(np.stack([points[q[need]], points[i[need]]], 1))
        return points, tree, forest, np.concatenate(made)

    def visit(state, q: np.ndarray) -> list[np.ndarray]:
        points, tree, forest, _ = state
        made, first = [], np.full(q.size, -1)
        for k, i in range_pairs(tree, points, q, np.arange(q.size), bits):
            k1, at = np.unique(k, return_index=True)
            new = k1[first[k1] < 0]
            first[new] = i[at[first[k1] < 0]]
            need = forest.link(first[k], i)
            made.append(np.stack([q[k[need]], points[i[need]]], 1))
        hit = np.nonzero(first >= 0)[0]
        return [np.stack([q[hit], points[first[hit]]], 1), *made]

    def frame(pairs: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(pairs.astype(np.uint64).view(np.int64).reshape(-1, 2), columns=["a", "b"])

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, owners, state = None, [], None
        for b in batches:
            for s, g in b.groupby("task", sort=True):
                if s != shard:
                    if owners and state is None:
                        yield frame(close(owners)[3])
                    shard, owners, state = s, [], None
                p, v = g["fp"].to_numpy().view(np.uint64), g["visits"].to_numpy()
                if (~v).any():
                    owners.append(p[~v])
                if v.any() and owners:
                    if state is None:
                        state = close(owners)
                        yield frame(state[3])
                    for pairs in visit(state, p[v]):
                        yield frame(pairs)
        if owners and state is None:
            yield frame(close(owners)[3])
    return link


def links(nodes: DataFrame, n: int, bits: int = MAX_BITS, shard_points: int | None = None) -> DataFrame:
    """A spanning forest (a, b) of all links within ``bits`` among distinct fingerprints.

    ``nodes(fp)`` are ``n`` distinct fingerprints in a written table. A shard
    owns about 64 sqrt(n) of them (16,384 at least), so its tree stays small
    beside an executor's memory while the visits stay few; visitors pass
    through in batches and are never held together.
    """
    target = shard_points or max(16384, int(64 * math.sqrt(max(n, 1))))
    shards = max(1, 1 << max(0, math.ceil(math.log2(max(n, 1) / target))))
    sample = [r["fp"] for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp")
              .limit(SAMPLE_PER_SHARD * shards).collect()] if shards > 1 else [0]
    points = np.array(sample, np.int64).view(np.uint64)
    tree = _top_tree(points, shards)
    plan = _task_plan(tree, points, shards, bits)
    dealt = nodes.select("fp").mapInPandas(_dealer(tree, plan, bits), "task int, visits boolean, fp long")
    # by number, not by hash: two shards never meet in one task
    return (dealt.repartitionById(sum(t for _, t in plan), F.col("task")).sortWithinPartitions("task", "visits")
            .mapInPandas(_linker(bits), "a long, b long"))


def _classes(prints: DataFrame) -> tuple[DataFrame, int]:
    """Per fingerprint of ``prints(doc_id, fp)``: component_id, smallest fingerprint of the component, rows."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    size = nodes.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    member = materialize(components(links(nodes, size["k"])), "members")
    root = F.coalesce(F.col("root"), F.col("fp"))
    joined = nodes.join(member, nodes["fp"] == member["node"], "left").select("fp", "first", "n", root.alias("root"))
    joined = materialize(joined, "joined")
    many = materialize(joined.join(member.select("root").distinct(), "root", "left_semi")
                       .groupBy("root").agg(F.min("first").alias("low")), "firsts")
    out = joined.join(many, "root", "left").select(
        "fp", "n", "root", F.coalesce("low", "first").alias("component_id"))
    return materialize(out, "classes"), size["n"] or 0


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs(doc_id, text)``."""
    prints = materialize(docs.select("doc_id", fingerprints("text").alias("fp")), "prints")
    classes, total = _classes(prints)
    return join_hot_key(prints, classes.select("fp", "n", "component_id"), "fp", "n", total).select(
        "doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row
    with the smallest doc_id (rows without one come last; of equal rows, one)."""
    names = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)],
                      fingerprints("text").alias("fp"), F.monotonically_increasing_id().alias("rid"))
    own = materialize(own, "marked")
    ident = F.col(f"c{names.index('doc_id')}")
    slim = own.select(ident.alias("doc_id"), "fp", "rid")
    classes, _ = _classes(slim)
    first = slim.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid")).alias("m"))
    kept = (first.join(classes.select("fp", "root"), "fp").groupBy("root").agg(F.min("m").alias("m"))
            .select(F.col("m.rid").alias("rid")))
    # shuffled by row number at every size, whatever Catalyst would broadcast while the table is small
    return own.join(materialize(kept, "kept").hint("shuffle_hash"), "rid", "left_semi").select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])

