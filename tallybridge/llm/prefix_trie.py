"""The trie of conversation prefixes, by double arrays per prefix shard.

A turn is a record of 20 bytes: 16 of a SHA-256 of its role and text, 4 for its words. A conversation is the chain of its
records, its *path*; a node is a prefix of a path and is recognised by a hash of it. Texts never travel.

1. Equal paths become one row with a count, so a conversation that a third of all users share is one row.
2. A path belongs to the shard of its first 1, 2, 4, 8 … turns: of so many that at most ``crowd`` different paths begin with
   them. Nodes above that cut are shared by several shards, all others lie in one shard alone.
3. A shard numbers its turns densely, packs BASE and CHECK arrays over these numbers, walks every path through them and sums
   up the subtrees from the deepest nodes upwards.
4. The shared upper nodes are merged over all shards, and each hands what is below it to all nodes above it.

Ids of the conversations that end in a node are hashed in order. They are sorted by range over the whole cluster, rendered to
blocks of text, and only the blocks of one node meet, one at a time.

Defined results: conversations are ordered by turn, null first, equal turns by the hash of role and text; a null role or text is
empty; rows without a conversation id belong to no conversation and are left out; an empty table has no node, not even the
root. One task holds the records of a whole conversation, 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybridge.operators.stored import Workspace

from .lookup import look_up
from .native import words_of
from .shipping import ship

RECORD, KEY = 20, 16
#: A beginning that more paths share than this, and more than so small a share of them, is cut deeper.
CROWD, CROWDS = 64, 16_384
#: Different paths that a shard holds on average.
SHARD_PATHS = 4_096
#: Bytes of a block of rendered ids.
BLOCK = 1 << 16


# -- paths --------------------------------------------------------------------------------


def paths(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
    """``(conv_id, path)``: every conversation as the chain of its records, in order."""
    role_text, whole = (F.coalesce(turns[f"`{c}`"], F.lit("")) for c in (role, text))
    named = F.concat(F.length(role_text).cast("string"), F.lit(":"), role_text, whole)
    record = F.concat(
        F.substring(F.sha2(named, 256), 1, 2 * KEY),
        F.lpad(F.hex(F.size(words_of(whole))), 2 * (RECORD - KEY), "0"),
    )
    rows = turns.where(turns[f"`{conv_id}`"].isNotNull()).select(
        turns[f"`{conv_id}`"].alias("conv_id"),
        F.struct(turns[f"`{turn}`"].alias("turn"), F.unhex(record).alias("record")).alias("at"),
    )
    in_order = F.transform(F.sort_array(F.collect_list("at")), lambda x: F.hex(x["record"]))
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(in_order, "")).alias("path"))


def with_borrowed_beginnings(given: DataFrame, family: int, most: int) -> DataFrame:
    """Every conversation with the first turns of another one in place of its own: of ``c - c % family``, as many as
    the CRC-32 of the id leaves of ``most + 1``; all it has if fewer, none if it is absent."""
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    turns = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1)) * RECORD
    lenders = given.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.substring("path", 1, most * RECORD).alias("lent")
    )
    rows = given.select("conv_id", "path", base, turns.cast("int").alias("bytes")).join(lenders, "base", "left")
    borrowed = F.coalesce(F.substring(F.col("lent"), F.lit(1), F.col("bytes")), F.lit(b""))
    own = F.substring(F.col("path"), F.col("bytes") + 1, F.octet_length("path"))
    return rows.select("conv_id", F.concat(borrowed, own).alias("path"))


def _key(path: Column) -> Column:
    """What a node is recognised by."""
    return F.unhex(F.substring(F.sha2(path, 256), 1, 2 * KEY))


# -- a double array ------------------------------------------------------------------------


class DoubleArray:
    """A trie over sequences of codes 1, 2, …: the child of ``s`` by ``c`` is ``base[s] + c``, if ``check`` there is ``s``."""

    ROOT = 0

    def __init__(self, sequences: list[tuple[int, ...]]):
        """``sequences`` are sorted and all different."""
        self.base, self.check = [0], [-2]
        self._free: list[int] = []
        stack = [(self.ROOT, 0, len(sequences), 0)]
        while stack:
            state, low, high, depth = stack.pop()
            while low < high and len(sequences[low]) == depth:  # a sequence that ends here
                low += 1
            if low == high:
                continue
            codes, starts = [], []
            for i in range(low, high):
                code = sequences[i][depth]
                if not codes or codes[-1] != code:
                    codes.append(code)
                    starts.append(i)
            base = self._place(codes)
            self.base[state] = base
            for code, begin, end in zip(codes, starts, [*starts[1:], high]):
                self.check[base + code] = state
                stack.append((base + code, begin, end, depth + 1))

    def _place(self, codes: list[int]) -> int:
        """The base that puts all codes into free cells: a gap for a single child, else room at the end."""
        if len(codes) == 1:
            while self._free:
                cell = self._free.pop()
                if self.check[cell] == -1:
                    return cell - codes[0]
        base = len(self.check) - codes[0]
        room = codes[-1] - codes[0] + 1
        self._free.extend(range(len(self.check), len(self.check) + room))
        self.base.extend([0] * room)
        self.check.extend([-1] * room)
        taken = {base + c for c in codes}
        self._free[-room:] = [cell for cell in self._free[-room:] if cell not in taken]
        return base

    def child(self, state: int, code: int) -> int:
        """The cell of a child, or -1."""
        cell = self.base[state] + code
        return cell if 0 < cell < len(self.check) and self.check[cell] == state else -1


@dataclass
class Nodes:
    """What a shard knows of its nodes, by place in the order they were first met."""

    key: list[bytes] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    convs: list[int] = field(default_factory=list)
    least: list[int] = field(default_factory=list)
    shared: list[bool] = field(default_factory=list)


def shard_nodes(rows: list[tuple[bytes, int, int, int]]) -> dict[str, list]:
    """The nodes of the paths of one shard, given as ``(path, conversations, least id, cut)``."""
    rows.sort()
    records = sorted({path[i : i + RECORD] for path, *_ in rows for i in range(0, len(path), RECORD)})
    code = {record: i for i, record in enumerate(records, 1)}
    chains = [tuple(code[path[i : i + RECORD]] for i in range(0, len(path), RECORD)) for path, *_ in rows]
    trie = DoubleArray(chains)
    nodes, at = Nodes(), [-1] * len(trie.check)
    for (_, convs, least, cut), chain in zip(rows, chains):
        state, above, path_hash = DoubleArray.ROOT, -1, hashlib.sha256()
        for depth in range(len(chain) + 1):
            if depth:
                state = trie.child(state, chain[depth - 1])
                path_hash.update(records[chain[depth - 1] - 1])
            place = at[state]
            if place < 0:
                place = at[state] = len(nodes.key)
                nodes.key.append(path_hash.digest()[:KEY])
                nodes.parent.append(above)
                nodes.depth.append(depth)
                words = records[chain[depth - 1] - 1][KEY:] if depth else b""
                nodes.words.append(int.from_bytes(words, "big"))
                nodes.convs.append(0)
                nodes.least.append(least)
                nodes.shared.append(depth < cut)
            nodes.convs[place] += convs
            nodes.least[place] = min(nodes.least[place], least)
            above = place
    return _summed(nodes)


def _summed(nodes: Nodes) -> dict[str, list]:
    """Children, leaves and saved tokens below each node, of nodes that lie in this shard alone; a node is met
    after its parent, so the deepest come last."""
    n = len(nodes.key)
    children, leaves, saved, bare = [0] * n, [0] * n, [0] * n, [True] * n
    for i in range(n - 1, -1, -1):
        if nodes.parent[i] >= 0:
            bare[nodes.parent[i]] = False
        if nodes.shared[i]:
            continue
        leaves[i] += children[i] == 0
        saved[i] += (nodes.convs[i] - 1) * nodes.words[i]
        if nodes.parent[i] >= 0:
            children[nodes.parent[i]] += 1
            leaves[nodes.parent[i]] += leaves[i]
            saved[nodes.parent[i]] += saved[i]
    above: list[bytes] = []  # keys of all nodes above a shared node, the root first
    parent_key, parent_least = [], []
    for i in range(n):
        p = nodes.parent[i]
        above.append(above[p] + nodes.key[p] if p >= 0 and nodes.shared[i] else b"")
        parent_key.append(nodes.key[p] if p >= 0 else None)
        parent_least.append(nodes.least[p] if p >= 0 and not nodes.shared[p] else None)
    return {
        "key": nodes.key, "parent_key": parent_key, "depth": nodes.depth, "words": nodes.words,
        "shared": nodes.shared, "above": above, "bare": bare, "conv_id": nodes.least, "parent_conv_id": parent_least,
        "n_convs": nodes.convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
    }


_NODES = (
    "key binary, parent_key binary, depth long, words long, shared boolean, above binary, bare boolean, conv_id long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
)


def _pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns))]
    if rows:
        schema = pa.schema([
            ("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()),
            ("shared", pa.bool_()), ("above", pa.binary()), ("bare", pa.bool_()),
            *[(c, pa.int64()) for c in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
        ])
        found = shard_nodes(rows)
        for batch in pa.Table.from_pydict(found, schema).to_batches(10_000):
            yield batch


# -- shards ---------------------------------------------------------------------------------


def _with_cuts(distinct: DataFrame, workspace: Workspace, total: int) -> DataFrame:
    """``distinct`` paths with ``cut``, the number of turns that name their shard, and ``shard``, a hash of these."""
    crowd = max(CROWD, -(-total // CROWDS))
    rows = distinct.withColumn("_depth", F.lit(1)).withColumn("_open", F.lit(True))
    depth = 1
    while True:
        beginning = F.xxhash64(F.substring("path", 1, depth * RECORD)).alias("_beginning")
        open_rows = rows.where("_open").select(beginning, (F.octet_length("path") > depth * RECORD).alias("_longer"))
        # Above total / CROWDS paths each: at most CROWDS of them.
        crowded = workspace.store(
            open_rows.groupBy("_beginning").agg(F.count(F.lit(1)).alias("n"), F.max("_longer").alias("_longer"))
            .where((F.col("n") > crowd) & F.col("_longer")).select("_beginning")
        )
        if crowded.isEmpty():
            break
        marked = rows.withColumn("_beginning", beginning).join(
            F.broadcast(crowded.withColumn("_crowded", F.lit(True))), "_beginning", "left"
        )
        still = F.col("_open") & F.col("_crowded").isNotNull()
        rows = marked.withColumn("_open", still).withColumn("_depth", F.when(still, 2 * depth).otherwise(F.col("_depth")))
        rows = rows.drop("_beginning", "_crowded")
        depth *= 2
    cut = F.col("_depth")
    return rows.select(
        "path", "n", "least", cut.alias("cut"),
        F.xxhash64(F.expr(f"substring(path, 1, _depth * {RECORD})")).alias("shard"),
    )


def _merged(shared: DataFrame, workspace: Workspace) -> DataFrame:
    """Shared nodes of all shards, each once, with what lies below them in all."""
    once = workspace.store(
        shared.groupBy("key", "parent_key", "depth", "words", "above").agg(
            F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("bare").alias("bare"),
            *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
        )
    )
    leaf = F.col("bare").cast("long")
    saved = (F.col("n_convs") - 1) * F.col("words")
    # The node itself comes as place 0, the node above it as place 1, and so on.
    to = F.transform(
        F.expr(f"sequence(0, cast(octet_length(above) / {KEY} as int))"),
        lambda i: F.struct(
            i.alias("place"),
            F.when(i == 0, F.col("key"))
            .otherwise(F.substring(F.col("above"), F.octet_length("above") - i * KEY + 1, F.lit(KEY)))
            .alias("key"),
        ),
    )
    handed = once.select(
        F.inline(to),
        F.col("n_children").alias("children"),
        (F.col("n_leaves") + leaf).alias("leaves"),
        (F.col("saved_tokens") + saved).alias("saved"),
    )
    below = handed.groupBy("key").agg(
        F.sum(F.when(F.col("place") == 0, F.col("children")).when(F.col("place") == 1, 1).otherwise(0)).alias("n_children"),
        F.sum("leaves").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    return once.select("key", "parent_key", "depth", "conv_id", "n_convs").join(below, "key")


def trie(given: DataFrame) -> DataFrame:
    """The nodes of the trie of ``(conv_id, path)``: ``key, conv_id`` (the least member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens``."""
    spark = given.sparkSession
    ship(spark)
    workspace = Workspace(spark)
    distinct = workspace.store(
        given.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    )
    total = distinct.count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_PATHS))
    dealt = _with_cuts(distinct, workspace, total).repartition(shards, "shard")
    nodes = workspace.store(dealt.select("path", "n", "least", "cut").mapInArrow(_pack_shards, _NODES))
    upper = workspace.store(_merged(nodes.where("shared"), workspace))
    out = ["key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    own = nodes.where("not shared")
    known = own.where("parent_conv_id is not null or parent_key is null").select(*out, "parent_conv_id")
    open_ = own.where("parent_conv_id is null and parent_key is not null").select(*out, "parent_key")
    open_ = workspace.store(open_.unionByName(upper.select(*out, "parent_key")))
    parents = upper.select(
        F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_asking")
    )
    found = look_up(open_, parents, "parent_key", "_asking", max(1, open_.count()))
    return known.unionByName(found.select(*out, "parent_conv_id"))


# -- conversations that end in a node ----------------------------------------------------------


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ``(key, conv_id)`` as blocks of text ``(key, first, ids)``."""
    key, first, ids, size = None, 0, [], 0
    for batch in batches:
        out = []
        for k, conv in zip(*(column.to_pylist() for column in batch.columns)):
            if ids and (k != key or size >= BLOCK):
                out.append((key, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                key, first = k, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if out:
            yield _blocks(out)
    if ids:
        yield _blocks([(key, first, ",".join(ids))])


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=["key", "first", "ids"]
    )


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the blocks of each key, which come in order."""
    key, state = None, None

    def done(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.string())],
            names=["key", "ends_sha256"],
        )

    for batch in batches:
        out = []
        for k, ids in zip(*(batch.column(name).to_pylist() for name in ("key", "ids"))):
            if k == key:
                state.update(b",")
            else:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield done(out)
    if state is not None:
        yield done([(key, state.hexdigest())])


def ends(given: DataFrame) -> DataFrame:
    """``(key, ends_sha256)``: the hash of the ids of the conversations whose path is the node, ascending, comma-joined."""
    ship(given.sparkSession)
    rows = given.select(_key(F.col("path")).alias("key"), "conv_id")
    ranges = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    blocks = ranges.mapInArrow(_render, "key binary, first long, ids string")
    sorted_blocks = blocks.repartition("key").sortWithinPartitions("key", "first")
    return sorted_blocks.mapInArrow(_hash, "key binary, ends_sha256 string")


def nodes_with_ends(given: DataFrame) -> DataFrame:
    """:func:`trie` of written ``(conv_id, path)`` rows, with ``ends_sha256``."""
    empty = hashlib.sha256(b"").hexdigest()
    both = trie(given).join(ends(given), "key", "left")
    return both.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty))).drop("key")
