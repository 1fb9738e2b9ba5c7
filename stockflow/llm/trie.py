"""Conversation prefix trie (operator 12) from double arrays per prefix shard.

A node is a distinct sequence of first turns (role, text). Turns are known by
the first 128 bits of the SHA-256 of role and text, so no text is shuffled.
Sequences are cut into segments of ``LEVELS`` turns; a segment is known by the
node it starts from. Equal segments from one node are merged first (a
conversation that many share is one row), the distinct ones are sorted by
range, so a first turn that a third of all conversations share spreads over
many tasks, and every ``SHARD`` consecutive ones form a prefix shard. A shard
numbers its turns densely, packs them into BASE and CHECK arrays, walks its
sequences through the arrays and sums over the nodes that they meet. Only the
nodes on a shard's first and last path (and where a segment ends) can occur in
another shard: those are merged globally, all others are final.

Sums over subtrees need no walk up the trie: every conversation *owns* the
nodes whose smallest member it is, a run from some depth to its end. A first
pass over the shards finds the owners; in a second one each conversation
carries the characters of all and of its own turns and whether it owns a leaf.
Sums of these over a node's members give the subtree's leaves and saved
characters, whatever the depth of the trie. A conversation of any length is
spread over its segments; only the identities of its segments are chained in
one task, one short row for ``LEVELS`` turns.

Rows without conv_id belong to no conversation. Null role or text is empty.
Turns are ordered by turn, null first; equal turns by the first 64 characters
of role, of text, then by their identity; equal rows are so many turns. An
empty table has no node. Extra columns are ignored. Digests of members that end
at a node are streamed in order from blocks of 65,536 possible ids, through one
task for a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import join_hot_key, materialize
from stockflow.plans.scan import running_sums

LEVELS, SHARD, SYMBOL = 32, 4096, 32
ROOT = ""
_TRIES = 16
NO_END = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """Double-array trie over sequences of dense symbols from 0, given in sorted order.

    The child of state s by symbol c is ``base[s] + c`` if ``check`` there is s.
    State 0 is the root. A state's children are put at the first of ``_TRIES``
    free places that holds them all, else behind the last place in use.
    """

    def __init__(self, rows: list[list[int]]):
        self.base, self.check = [0], [-1]
        self._free = 1
        level, depth = [(0, 0, len(rows))], 0
        while level:
            below = []
            for state, start, end in level:
                children, k = [], start
                while k < end:  # rows that end here sort first
                    if len(rows[k]) <= depth:
                        k += 1
                        continue
                    c, first = rows[k][depth], k
                    while k < end and rows[k][depth] == c:
                        k += 1
                    children.append((c, first, k))
                if children:
                    at = self.base[state] = self._place([c for c, _, _ in children])
                    for c, first, last in children:
                        self.check[at + c] = state
                        below.append((at + c, first, last))
            level, depth = below, depth + 1
        self.base, self.check = np.array(self.base), np.array(self.check)

    def _place(self, symbols: list[int]) -> int:
        used, low, n = self.check, symbols[0], len(self.check)
        while self._free < n and used[self._free] >= 0:
            self._free += 1
        at, tried = max(self._free, low), 0
        while at < n and tried < _TRIES:
            if used[at] == -1 and at and all(at - low + c >= n or used[at - low + c] == -1 for c in symbols):
                break
            at, tried = at + 1, tried + 1
        else:
            at = max(n, low)
        need = at - low + symbols[-1] + 1 - n
        self.base += [0] * need
        self.check += [-1] * need
        return at - low

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states reached, -1 where there is none."""
        to = self.base[states] + symbols
        inside = to < len(self.check)
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def node_key(prefix: str, path: str) -> str:
    """Identity of the node that ``path`` reaches from the node ``prefix``."""
    return hashlib.sha256((prefix + path).encode()).hexdigest()[:SYMBOL] if path else prefix


def _key(prefix: Column, path: Column) -> Column:
    return F.when(path == "", prefix).otherwise(F.substring(F.sha2(F.concat(prefix, path), 256), 1, SYMBOL))


# ------------------------------------------------------------------ sequences
def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, symbol, chars) of every turn; a conversation of any length spreads over many tasks."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(role, 1, 64).alias("role"),
        F.substring(text, 1, 64).alias("text"), F.length(text).cast("long").alias("chars"),
        F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, SYMBOL).alias("symbol"),
        F.monotonically_increasing_id().alias("uid"), F.lit(1).cast("long").alias("one"))
    return running_sums(rows, ["conv_id"], ["turn", "role", "text", "symbol", "uid"], {"pos": "one"}).select(
        "conv_id", "pos", "symbol", "chars")


def rebuilt_turns(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, len, depth, symbol, chars), a row without symbol for a conversation without turn.

    Conversation c becomes the first h turns of conversation c - c % every and
    its own turns after its first h; h = crc32(decimal c) % most."""
    head_of = F.col("conv_id") - F.col("conv_id") % every
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = (turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("head"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "symbol", "chars"))).alias("first")))  # most - 1 turns
    plan = materialize(
        convs.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % most).withColumn("head", head_of)
        .join(heads, "head", "left").withColumn("first", F.slice(F.coalesce("first", F.array()), F.lit(1), F.col("h").cast("int")))
        .withColumn("k", F.size("first").cast("long")).withColumn("len", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select("conv_id", "n", "h", "k", "len", "first"), "plan")
    own = (join_hot_key(turns, plan.drop("first"), "conv_id", "n", turns.count()).filter(F.col("pos") > F.col("h"))
           .select("conv_id", "len", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "symbol", "chars"))
    lent = plan.select("conv_id", "len", F.explode("first").alias("t")).select(
        "conv_id", "len", F.col("t.pos").alias("depth"), "t.symbol", "t.chars")
    bare = plan.filter("len = 0").select("conv_id", "len", F.lit(1).cast("long").alias("depth"), F.lit("").alias("symbol"),
                                         F.lit(0).cast("long").alias("chars"))
    return own.unionByName(lent).unionByName(bare)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Start node and characters before of each segment of the conversations that come, in order."""
    conv, prefix, before = None, ROOT, 0
    for b in batches:
        prefixes, befores = [], []
        for c, path, chars in zip(b.column("conv_id").to_pylist(), b.column("path").to_pylist(), b.column("sum").to_pylist()):
            if c != conv:
                conv, prefix, before = c, ROOT, 0
            prefixes.append(prefix)
            befores.append(before)
            prefix, before = node_key(prefix, path), before + chars
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prefixes, pa.string()), pa.array(befores, pa.int64())],
                                         names=[*b.schema.names, "prefix", "before"])


def segments(turns: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(conv_id, seg, path, chars, sum, last, prefix, before): each conversation's turns, ``levels`` at a time."""
    turn = F.sort_array(F.collect_list(F.struct("depth", "symbol", "chars")))
    rows = (turns.groupBy("conv_id", "len", F.floor((F.col("depth") - 1) / levels).alias("seg")).agg(turn.alias("t"))
            .select("conv_id", "len", "seg", F.array_join("t.symbol", "").alias("path"), F.col("t.chars").alias("chars"),
                    F.aggregate("t.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum"),
                    ((F.col("seg") + 1) * levels >= F.col("len")).cast("long").alias("last")))
    rows = materialize(rows, "segments")
    short = rows.filter(F.col("len") <= levels).withColumns({"prefix": F.lit(ROOT), "before": F.lit(0).cast("long")})
    long = rows.filter(F.col("len") > levels).repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in short.schema.fields)
    return materialize(short.unionByName(long.mapInArrow(_chain, schema)).drop("len"), "sequences")


# ---------------------------------------------------------------------- shards
SUMS = ["n", "ended", "total", "owned", "leaves"]
_NODES = ("key string, parent string, parent_conv long, depth long, chars long, before long, shared boolean, edge boolean, kids long, "
          "conv_id long, start long, " + ", ".join(f"{s} long" for s in SUMS))


def _shard(rows: dict[str, list], levels: int) -> dict[str, list]:
    """The nodes of one shard: consecutive distinct sequences with their sums."""
    prefixes, paths, count = rows["prefix"], rows["path"], len(rows["path"])
    turns = [[p[i:i + SYMBOL] for i in range(0, len(p), SYMBOL)] for p in paths]
    dense = {s: k for k, s in enumerate(sorted({s for t in turns for s in t}))}
    tops = {p: len(dense) + k for k, p in enumerate(sorted(set(prefixes)))}
    codes = [[tops[p], *(dense[s] for s in t)] for p, t in zip(prefixes, turns)]
    trie = DoubleArray(codes)
    sizes = np.array([len(t) for t in turns])
    table = np.zeros((count, int(sizes.max()) + 1), np.int64)
    for k, c in enumerate(codes):
        table[k, :len(c)] = c
    conv, start = np.array(rows["conv_id"], np.int64), np.array(rows["start"], np.int64)
    sums = np.array([rows[s] for s in SUMS], np.int64)
    before = np.array(rows["before"], np.int64)
    chars = np.zeros((count, int(sizes.max()) + 1), np.int64)
    for k, c in enumerate(rows["chars"]):
        chars[k, 1:sizes[k] + 1] = c[:sizes[k]]  # a conversation without turn has one entry of nothing
    out: dict[str, list] = {c.split()[0]: [] for c in _NODES.split(", ")}
    place: dict[int, int] = {}  # state -> its row in ``out``
    at, state = np.arange(count), np.zeros(count, np.int64)
    for d in range(table.shape[1]):
        going = sizes[at] >= d
        at, state = at[going], state[going]
        state = trie.step(state, table[at, d])
        first = np.flatnonzero(np.append(True, state[1:] != state[:-1]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
        least = np.minimum.reduceat(conv[at], first)
        begin = np.zeros(len(first), np.int64)
        found = conv[at] == least[run]
        begin[run[found]] = start[at[found]]
        carried = sums[:, at]
        carried[SUMS.index("ended"), sizes[at] > d] = 0  # only who ends at the node itself
        added = np.add.reduceat(carried, first, axis=1)
        edge = {int(run[0])} if at[0] == 0 else set()
        if at[-1] == count - 1:
            edge.add(int(run[-1]))
        for r, i in enumerate(at[first].tolist()):
            prefix, s = prefixes[i], int(state[first[r]])
            own = d > 0 or prefix == ROOT  # else the node itself comes from the segment above
            edged = d > 0 and r in edge  # may be in a neighbouring shard as well
            shared = edged or d in (0, levels)
            above = place.get(int(trie.check[s])) if d else None
            hidden = above is not None and out["shared"][above]
            if above is not None and not edged:
                out["kids"][above] += 1
            place[s] = len(out["key"])
            out["key"].append(node_key(prefix, paths[i][:d * SYMBOL]))
            out["parent"].append(out["key"][above] if above is not None else None)
            out["parent_conv"].append(None if above is None or hidden else out["conv_id"][above])
            out["depth"].append(rows["seg"][i] * levels + d if own else None)
            out["chars"].append(int(chars[i, d]) if own else None)
            out["before"].append(int(before[i] + chars[i, :d].sum()) if own else None)
            out["shared"].append(shared)
            out["edge"].append(edged)
            out["kids"].append(0)
            out["conv_id"].append(int(least[r]) if own else None)
            out["start"].append(int(begin[r]) if own else None)
            for k, name in enumerate(SUMS):
                out[name].append(int(added[k, r]) if own else 0)
    return out


def _sharder(levels: int, size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def nodes(rows: dict[str, list]) -> pa.RecordBatch:
            out, types = _shard(rows, levels), {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
            shape = [c.split() for c in _NODES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(out[c], types[t]) for c, t in shape], names=[c for c, _ in shape])

        for b in batches:
            for name, column in zip(b.schema.names, b.columns):
                held.setdefault(name, []).extend(column.to_pylist())
            while held and len(held["path"]) >= size:
                yield nodes({k: v[:size] for k, v in held.items()})
                held = {k: v[size:] for k, v in held.items()}
        if held and held["path"]:
            yield nodes(held)

    return make


def trie_nodes(sequences: DataFrame, name: str, levels: int = LEVELS, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(nodes that one shard holds whole, merged nodes of several): ``sequences`` has a conversation's
    segments with its ``total``, ``owned``, ``leaves`` and ``start``."""
    members = F.sum(F.lit(1)).alias("n"), F.sum("last").alias("ended")
    carried = [F.sum(c).alias(c) for c in SUMS[2:]]
    distinct = (sequences.groupBy("prefix", "seg", "path")
                .agg(*members, *carried, F.min(F.struct("conv_id", "start")).alias("least"), F.first("chars").alias("chars"),
                     F.first("before").alias("before"))
                .select("prefix", "seg", "path", "chars", "before", "least.conv_id", "least.start", *SUMS))
    n = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = distinct.repartitionByRange(n, "prefix", "path").sortWithinPartitions("prefix", "path")
    found = materialize(dealt.mapInArrow(_sharder(levels, shard), _NODES), name)
    merged = (found.filter("shared").groupBy("key")
              .agg(*[F.max(c).alias(c) for c in ("parent", "parent_conv", "depth", "chars", "before", "edge")], F.sum("kids").alias("kids"),
                   F.min(F.when(F.col("conv_id").isNotNull(), F.struct("conv_id", "start"))).alias("least"),
                   *[F.sum(s).alias(s) for s in SUMS])
              .select("*", "least.*").drop("least"))
    return found.filter(~F.col("shared")).drop("shared", "edge"), materialize(merged, f"{name}_merged")


def owners(sequences: DataFrame, levels: int, shard: int) -> DataFrame:
    """(conv_id, owned, start, leaves): characters of the nodes whose smallest member the conversation is,
    characters before the first of them, and whether the last has no child. Others own nothing."""
    zero = {c: F.lit(0).cast("long") for c in ("total", "owned", "leaves", "start")}
    whole, merged = trie_nodes(sequences.withColumns(zero), "owners", levels, shard)
    columns = ["conv_id", "chars", "before", "n", "ended"]
    return whole.select(*columns).unionByName(merged.select(*columns)).groupBy("conv_id").agg(
        F.sum("chars").alias("owned"), F.min("before").alias("start"),
        F.max((F.col("n") == F.col("ended")).cast("long")).alias("leaves"))


# --------------------------------------------------------------------- results
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None
    for b in batches:
        done = []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], names=["key", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "ends"])


def end_digests(sequences: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the ascending conv_ids that end at each node. Blocks of ids are joined where
    they lie and streamed in order; a node's digest itself can only be taken in one task."""
    blocks = (sequences.filter("last = 1").select(_key(F.col("prefix"), F.col("path")).alias("key"), "conv_id")
              .groupBy("key", F.shiftright("conv_id", 16).alias("block"))
              .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))  # 65,536 at most
              .select("key", "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids")))
    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_digests, "key string, ends string")


def prefix_trie(turns: DataFrame, levels: int = LEVELS, shard: int = SHARD) -> DataFrame:
    """One row for each node of the trie of all ``turns`` (as ``rebuilt_turns`` gives them): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node."""
    sequences = segments(turns, levels)
    convs = sequences.groupBy("conv_id").agg(F.sum("sum").alias("total"), F.count("*").alias("parts"))
    facts = materialize(convs.join(owners(sequences, levels, shard), "conv_id", "left").fillna(0), "facts")
    carried = join_hot_key(sequences, facts, "conv_id", "parts", sequences.count())
    whole, merged = trie_nodes(carried, "nodes", levels, shard)

    below = merged.filter("edge").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    merged = materialize(merged.join(below, "key", "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0)))
                         .drop("more", "edge"), "merged")
    nodes = whole.unionByName(merged)
    known = F.col("parent_conv").isNotNull() | F.col("parent").isNull()
    orphans = nodes.filter(~known).drop("parent_conv")
    parents = merged.select(F.col("key").alias("parent"), F.col("kids").alias("kids_of"), F.col("conv_id").alias("parent_conv"))
    found = join_hot_key(orphans, parents, "parent", "kids_of", orphans.count())
    saved = (F.col("total") - F.col("n") * F.col("before")) - (F.col("owned") + F.col("start") - F.col("before"))
    return (nodes.filter(known).unionByName(found).join(end_digests(sequences), "key", "left")
            .select("conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                    F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
                    F.coalesce("ends", F.lit(NO_END)).alias("ends_sha256"), F.col("key").alias("node")))


def conversation_trie(conversations: DataFrame, every: int = 100, most: int = 6, levels: int = LEVELS,
                      shard: int = SHARD) -> DataFrame:
    """The prefix trie of all conversations after ``rebuilt_turns``."""
    turns = materialize(ordered_turns(conversations.select("conv_id", "turn", "role", "text")), "turns")
    return prefix_trie(rebuilt_turns(turns, every, most), levels, shard)
