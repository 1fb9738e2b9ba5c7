"""Nearest neighbours (operator 8) with a vantage-point tree per shard.

A vantage-point tree over a bounded sample deals the vectors into shards that
are compact in space; each shard builds its own tree. A query is answered in
its home shard first, which bounds how far its k-th neighbour can be. With
that bound it visits only the shards, and in them only the branches, that the
triangle inequality cannot rule out. The bound is multiplied by ``factor`` when
branches are ruled out: 1 is exact, less prunes more. Distances are Euclidean
in double precision on the original vectors.

Equal vectors are one point, which keeps its ``k + 1`` smallest vec_ids: more
of them can never be among k neighbours, so a vector that is repeated in a
third of all rows costs no more than another and nothing is lost. Equal
queries are searched once.

Vectors that are null, zero, empty, or hold null or non-finite components take
no part, nor do vectors whose length is not the most frequent one (ties: the
smaller). Null vec_ids are never queries and sort last. A repeated row is a
row of its own: it is a candidate for its twin. Fewer candidates than k give
fewer rows; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockflow.llm.common import join_hot_key, materialize

K, QUERY_EVERY, FACTOR = 10, 100, 0.6
LEAF, SAMPLE_PER_SHARD, SHARD_LEAST, SHARD_MOST = 64, 64, 4096, 1 << 17
CELLS = 1 << 21
#: Stands for a null id, which sorts last.
NAMELESS = (1 << 63) - 1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row of ``a`` to each of ``b``, by differences."""
    out = np.empty((len(a), len(b)))
    step = max(1, CELLS // max(1, b.size))
    for at in range(0, len(a), step):
        diff = a[at:at + step, None, :] - b[None, :, :]
        out[at:at + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def build_tree(x: np.ndarray, index: np.ndarray, leaf: int, depth: int = 64):
    """A nested tree (vantage vector, radius, inner, outer) or an index array.

    The vantage point is the one of a few candidates whose distances spread
    most; the radius is their median.
    """
    if index.size <= leaf or not depth:
        return index
    tried = x[index[np.linspace(0, index.size - 1, 8).astype(int)]]
    probe = x[index[::max(1, index.size // 128)]]
    v = tried[int(distances(tried, probe).var(1).argmax())]
    d = distances(v[None], x[index])[0]
    mid = float(np.partition(d, (d.size - 1) // 2)[(d.size - 1) // 2])
    inside = d <= mid
    if inside.all():
        return index
    return v, mid, build_tree(x, index[inside], leaf, depth - 1), build_tree(x, index[~inside], leaf, depth - 1)


class Searcher:
    """k nearest points of one shard for a batch of queries."""

    def __init__(self, x: np.ndarray, first: np.ndarray, k: int, factor: float):
        self.x, self.first, self.k, self.factor = x, first, k, factor
        self.tree = build_tree(x, np.arange(len(x)), LEAF)

    def __call__(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances, point indexes) of each query's k nearest, inf and -1 where there are fewer."""
        self.q, self.bound = q, bound
        self.best = np.full((len(q), self.k), np.inf)
        self.at = np.full((len(q), self.k), -1)
        self._search(self.tree, np.arange(len(q)))
        return self.best, self.at

    def _search(self, tree, own: np.ndarray) -> None:
        if not own.size:
            return
        if not isinstance(tree, tuple):
            step = max(1, CELLS // max(1, tree.size * 8))
            for at in range(0, own.size, step):
                self._merge(tree, own[at:at + step])
            return
        v, mid, inner, outer = tree
        d = distances(self.q[own], v[None])[:, 0]
        inside = d <= mid
        self._search(inner, own[inside])
        self._search(outer, own[~inside])
        reach = self.factor * np.minimum(self.best[own, -1], self.bound[own])
        self._search(outer, own[inside & (d + reach >= mid)])
        self._search(inner, own[~inside & (d - reach <= mid)])

    def _merge(self, points: np.ndarray, own: np.ndarray) -> None:
        d = np.concatenate([self.best[own], distances(self.q[own], self.x[points])], 1)
        at = np.concatenate([self.at[own], np.broadcast_to(points, (own.size, points.size))], 1)
        tie = np.where(at < 0, np.iinfo(np.int64).max, self.first[at])
        order = np.lexsort((tie, d), axis=-1)[:, :self.k]
        self.best[own] = np.take_along_axis(d, order, 1)
        self.at[own] = np.take_along_axis(at, order, 1)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def _numbered(tree, number):
    return (*tree[:2], _numbered(tree[2], number), _numbered(tree[3], number)) if isinstance(tree, tuple) else next(number)


def _home(tree, x: np.ndarray) -> np.ndarray:
    out, stack = np.zeros(len(x), np.int32), [(tree, np.arange(len(x)))]
    while stack:
        t, own = stack.pop()
        if not isinstance(t, tuple):
            out[own] = t
        elif own.size:
            inside = distances(x[own], t[0][None])[:, 0] <= t[1]
            stack += [(t[2], own[inside]), (t[3], own[~inside])]
    return out


def _reached(tree, x: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, rows of ``x`` whose ball of radius ``reach`` may touch it)."""
    stack = [(tree, np.arange(len(x)))]
    while stack:
        t, own = stack.pop()
        if not isinstance(t, tuple):
            yield t, own
        elif own.size:
            d = distances(x[own], t[0][None])[:, 0]
            stack += [(t[2], own[d - reach[own] <= t[1]]), (t[3], own[d + reach[own] >= t[1]])]


def _answerer(k: int, factor: float):
    """Streams a shard's points (first) and the queries that visit it."""
    cols = ["qid", "score", "vec_id", "rid", "nameless"]

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, points, search = None, [], None
        for b in batches:
            for s, g in b.groupby("shard", sort=True):
                if s != shard:
                    shard, points, search = s, [], None
                own, asks = g[~g["asks"]], g[g["asks"]]
                if len(own):
                    points.append(own)
                if len(asks) and points:
                    if search is None:
                        p = pd.concat(points)
                        rows = [list(zip(n, i, r)) for n, i, r in zip(p["nameless"], p["ids"], p["rids"])]
                        first = np.array([r[0][1] for r in rows], np.int64)
                        search = Searcher(_matrix(p["v"]), first, k, factor)
                    out = []
                    best, at = search(_matrix(asks["v"]), asks["bound"].to_numpy())
                    for q, ds, ps in zip(asks["qid"].tolist(), best.tolist(), at.tolist()):
                        found = sorted((d, *row) for d, p in zip(ds, ps) if p >= 0 for row in rows[p])
                        out += [(q, d, i, r, n) for d, n, i, r in found[:k]]
                    yield pd.DataFrame(out, columns=cols)
    return answer


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows of ``table(vec_id, embedding)`` that take part."""
    v = F.col("embedding")
    good = (v.isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = table.select("vec_id", "embedding").filter(F.coalesce(good, F.lit(False)))
    length = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    return rows.filter(F.size(v) == (length[0]["d"] if length else 0)).select("vec_id", v.alias("v"))


def nearest(table: DataFrame, k: int = K, query_every: int = QUERY_EVERY, factor: float = FACTOR,
            shard_points: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row whose vec_id is divisible by ``query_every``."""
    rows = materialize(valid_vectors(table).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    asked = rows.filter(F.col("vec_id") % query_every == 0)
    copies = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last(), "rid")
    few = rows.withColumn("n", F.row_number().over(copies)).filter(F.col("n") <= k + 1)
    held = F.sort_array(F.collect_list(F.struct("n", "vec_id", "rid")))
    # null ids are told apart by a flag: pandas would round longs beside a null
    points = materialize(few.groupBy("v").agg(held.alias("h")).select(
        "v", F.transform("h", lambda x: F.coalesce(x["vec_id"], F.lit(NAMELESS))).alias("ids"),
        F.transform("h", lambda x: x["vec_id"].isNull()).alias("nameless"), F.col("h.rid").alias("rids")), "points")
    queries = materialize(asked.groupBy("v").agg(F.count("*").alias("n"))
                          .withColumn("qid", F.monotonically_increasing_id()), "queries")
    n = points.count()
    target = shard_points or min(SHARD_MOST, max(SHARD_LEAST, int(16 * math.sqrt(max(n, 1)))))
    depth = max(0, math.ceil(math.log2(max(n, 1) / target)))
    sample = points.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE_PER_SHARD << depth).collect() if depth else []
    x = np.array([r["v"] for r in sample], np.float64)
    tree = _numbered(build_tree(x, np.arange(len(x)), 1, depth), iter(range(1 << 62)))
    kind = dict(points.dtypes)["v"]

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series(_home(tree, _matrix(v)) if len(v) else [], dtype="int32")

    none = lambda t: F.lit(None).cast(t)
    owners = points.select(home("v").alias("shard"), F.lit(False).alias("asks"), none("long").alias("qid"), "v",
                           none("double").alias("bound"), "ids", "nameless", "rids")

    def search(visits: DataFrame) -> DataFrame:
        asks = visits.select("shard", F.lit(True).alias("asks"), "qid", "v", "bound",
                             none("array<long>").alias("ids"), none("array<boolean>").alias("nameless"),
                             none("array<long>").alias("rids"))
        both = owners.unionByName(asks).repartition(1 << depth, "shard").sortWithinPartitions("shard", "asks")
        found = both.mapInPandas(_answerer(k + 1, factor), "qid long, score double, vec_id long, rid long, nameless boolean")
        return found.select("qid", "score", F.when(~F.col("nameless"), F.col("vec_id")).alias("vec_id"), "rid")

    near = materialize(search(queries.select(home("v").alias("shard"), "qid", "v", F.lit(float("inf")).alias("bound"))),
                       "home_answers")
    bounds = near.groupBy("qid").agg(F.count("*").alias("c"), F.max("score").alias("s"))
    bounds = bounds.select(F.col("qid").alias("b"), F.when(F.col("c") > k, F.col("s")).otherwise(
        F.lit(float("inf"))).alias("bound"))
    bounded = queries.join(bounds, F.col("qid") == F.col("b"), "left").select(
        "qid", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), home("v").alias("own"))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, own = _matrix(b["v"]), b["own"].to_numpy()
            if not len(x):
                continue
            for shard, at in _reached(tree, x, factor * b["bound"].to_numpy()):
                out = b.iloc[at[own[at] != shard]][["qid", "v", "bound"]]
                out.insert(0, "shard", np.int32(shard))
                yield out

    far = search(bounded.mapInPandas(visit, f"shard int, qid long, v {kind}, bound double"))
    order = [F.col("score"), F.col("vec_id").asc_nulls_last(), F.col("rid")]
    best = (near.unionByName(far).withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
            .filter(F.col("at") <= k + 1).groupBy("qid")
            .agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "rid", "score"))).alias("found")))
    answers = materialize(queries.join(best, "qid").select("v", "n", "found"), "answers")
    total = answers.agg(F.sum("n").alias("n")).first()["n"] or 0
    mine = join_hot_key(asked.select(F.col("vec_id").alias("query_id"), F.col("rid").alias("me"), "v"), answers,
                        "v", "n", total)
    others = F.slice(F.filter("found", lambda f: f["rid"] != F.col("me")), 1, k)
    return (mine.select("query_id", F.posexplode(others).alias("p", "f"))
            .select("query_id", (F.col("p") + 1).alias("rank"), "f.vec_id", "f.score"))
