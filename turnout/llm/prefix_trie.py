"""Conversation prefix trie: which conversations begin alike, as adaptive radix trees over turn ids.

A turn's id is a fixed number of big-endian bytes, a conversation the bytes of its turns one after the
other. Spark sorts all conversations by these bytes and cuts the order into pieces of bounded size.
A task builds an adaptive radix tree of each piece; depths that end a turn are nodes of the result.
Nodes inside a piece are whole. Those on the way to its first or last conversation may continue in
the pieces beside it: their sums are added up, less what two neighbours counted both.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import apart, field, packed, small_table, stored, text_or_empty

# Bytes of a turn id. A piece ends after so many conversations, or so many turns.
WIDTH = 16
PIECE_CONVERSATIONS, PIECE_TURNS = 20_000, 200_000
# A piece is numbered by its partition and its place there.
PLACE_BITS = 32


class Layout:
    """The children of a tree node by their first byte; each kind holds up to ``size`` of them."""

    __slots__ = ("at", "children")
    size = 0

    def __init__(self, items=()):
        self.at, self.children = [], []
        for byte, child in items:
            self.put(byte, child)

    def full(self) -> bool:
        return len(self) >= self.size

    def __len__(self) -> int:
        return len(self.children)


class Sorted4(Layout):
    """Sorted first bytes beside their children."""

    __slots__ = ()
    size = 4

    def get(self, byte: int):
        k = bisect_left(self.at, byte)
        return self.children[k] if k < len(self.at) and self.at[k] == byte else None

    def put(self, byte: int, child) -> None:
        k = bisect_left(self.at, byte)
        if k < len(self.at) and self.at[k] == byte:
            self.children[k] = child
        else:
            self.at.insert(k, byte)
            self.children.insert(k, child)

    def items(self):
        return zip(self.at, self.children)


class Sorted16(Sorted4):
    __slots__ = ()
    size = 16


class Indexed48(Layout):
    """The place of a child in an index of 256 bytes, 0 for none."""

    __slots__ = ()
    size = 48

    def __init__(self, items=()):
        self.at, self.children = bytearray(256), []
        for byte, child in items:
            self.put(byte, child)

    def get(self, byte: int):
        k = self.at[byte]
        return self.children[k - 1] if k else None

    def put(self, byte: int, child) -> None:
        if self.at[byte]:
            self.children[self.at[byte] - 1] = child
        else:
            self.children.append(child)
            self.at[byte] = len(self.children)

    def items(self):
        return ((byte, self.children[k - 1]) for byte, k in enumerate(self.at) if k)


class Direct256(Layout):
    """A child, or none, for every byte."""

    __slots__ = ()
    size = 256

    def __init__(self, items=()):
        self.at, self.children = 0, [None] * 256
        for byte, child in items:
            self.put(byte, child)

    def __len__(self) -> int:
        return self.at

    def get(self, byte: int):
        return self.children[byte]

    def put(self, byte: int, child) -> None:
        self.at += self.children[byte] is None
        self.children[byte] = child

    def items(self):
        return ((byte, child) for byte, child in enumerate(self.children) if child is not None)


LARGER = {Sorted4: Sorted16, Sorted16: Indexed48, Indexed48: Direct256}


class Node:
    """``prefix`` is the compressed path after the byte that leads here, ``key`` any key below."""

    __slots__ = ("prefix", "key", "value", "layout")

    def __init__(self, prefix: bytes, key: bytes, value=None):
        self.prefix, self.key, self.value, self.layout = prefix, key, value, Sorted4()

    def put(self, byte: int, child: Node) -> None:
        if self.layout.full() and self.layout.get(byte) is None:
            self.layout = LARGER[type(self.layout)](self.layout.items())
        self.layout.put(byte, child)


class RadixTree:
    """Byte strings, any of which may begin another, with a value each."""

    def __init__(self) -> None:
        self.root = Node(b"", b"")

    def insert(self, key: bytes, value) -> None:
        parent, edge, node, at = None, 0, self.root, 0
        while True:
            prefix = node.prefix
            n = _shared(prefix, key, at)
            if n < len(prefix):
                # The compressed path parts here.
                upper = Node(prefix[:n], key)
                node.prefix = prefix[n + 1 :]
                upper.put(prefix[n], node)
                parent.put(edge, upper)
                node = upper
            at += n
            if at == len(key):
                node.value = value
                return
            child = node.layout.get(key[at])
            if child is None:
                node.put(key[at], Node(key[at + 1 :], key, value))
                return
            parent, edge, node = node, key[at], child
            at += 1

    def turns(self, width: int) -> Iterator[tuple[int, int, bytes, object]]:
        """(number of the parent, depth, key, value) of every byte depth that ends a turn, parents first.

        ``key`` begins with the node's turns; ``value`` is that of the string which ends there.
        """
        yield -1, 0, b"", self.root.value
        count = 1
        stack = [(child, 1, 0) for _, child in sorted(self.root.layout.items(), key=_first, reverse=True)]
        while stack:
            node, start, parent = stack.pop()
            end = start + len(node.prefix)
            # The byte that leads here lies before ``start``.
            for depth in range((start - 1) // width + 1, end // width + 1):
                yield parent, depth, node.key, node.value if depth * width == end else None
                parent, count = count, count + 1
            stack += [
                (child, end + 1, parent) for _, child in sorted(node.layout.items(), key=_first, reverse=True)
            ]


def _first(item):
    return item[0]


def _shared(prefix: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``prefix`` the key has from ``at`` on."""
    if key.startswith(prefix, at):
        return len(prefix)
    return next(k for k, byte in enumerate(prefix) if at + k >= len(key) or key[at + k] != byte)


def turn_id(role: Column, text: Column) -> Column:
    """The first 128 bits of the SHA-256 of role and text."""
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(named, 256), 1, 2 * WIDTH))


def turn_sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with ``turns`` an array of (id, chars), for rows (conv_id, turn, role, text).

    Rows are ordered by turn, null first, then by role and id, so ties and repeated rows have one order
    and all stay. A null role or text is empty. Rows without a conv_id belong to no conversation and
    are left out. ``chars`` are code points of the text. Further columns are ignored.

    Texts stay where they are read; ids and lengths of a conversation meet in one row.
    """
    rows = packed(turns).where(field("conv_id").isNotNull())
    role, text = F.coalesce(field("role"), F.lit("")), text_or_empty()
    turn = F.struct(
        field("turn").alias("turn"),
        role.alias("role"),
        turn_id(role, text).alias("id"),
        F.length(text).cast("long").alias("chars"),
    )
    lists = rows.select(field("conv_id").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns")
    )
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


_NODES = (
    "kind string, piece bigint, node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, weighed bigint, once bigint, ends string, "
    "ids array<binary>, chars array<bigint>"
)
_NAMES = [part.split()[0] for part in _NODES.split(", ")]
_ARROW = pa.schema(
    [
        ("kind", pa.string()), ("piece", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()),
        *((n, pa.int64()) for n in _NAMES[4:12]), ("ends", pa.string()),
        ("ids", pa.list_(pa.binary())), ("chars", pa.list_(pa.int64())),
    ]
)


def _named(parent: bytes, turn: bytes) -> bytes:
    """The name of a node below ``parent``; the root's is empty."""
    return hashlib.blake2b(parent + turn, digest_size=WIDTH).digest()


def _path(ids: list[bytes]) -> list[bytes]:
    names = [b""]
    for turn in ids:
        names.append(_named(names[-1], turn))
    return names


def _decimals(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def piece_nodes(piece: int, rows: list[tuple[list[bytes], list[int], int]]) -> Iterator[dict]:
    """Rows of ``_NODES`` for one piece, (ids, chars, conv_id) in order.

    A ``closed`` node has all its members here; an ``open`` one is on the way to the first or last
    conversation, and has sums that can be added: ``weighed`` is members times code points over the
    subtree, ``once`` the code points. ``first`` and ``last`` hold those two conversations.
    """
    tree, chars, members = RadixTree(), {}, None
    before = None
    for ids, lengths, conv_id in rows:
        if ids != before:
            members = []
            tree.insert(b"".join(ids), members)
            chars.update(zip(ids, lengths))
            before = ids
        members.append(conv_id)
    parents, depths, names, ends = [], [], [], []
    n_convs, least, weighed, once = [], [], [], []
    for parent, depth, key, value in tree.turns(WIDTH):
        turn = key[(depth - 1) * WIDTH : depth * WIDTH] if depth else b""
        parents.append(parent)
        depths.append(depth)
        names.append(_named(names[parent], turn) if depth else b"")
        ends.append(value or [])
        n_convs.append(len(value or []))
        least.append(min(value) if value else None)
        once.append(chars[turn] if depth else 0)
    size = list(once)
    n_children, n_leaves, weighed = [0] * len(names), [0] * len(names), [0] * len(names)
    for k in range(len(names) - 1, -1, -1):
        n_leaves[k] = n_leaves[k] or 1
        weighed[k] += n_convs[k] * size[k]
        p = parents[k]
        if p >= 0:
            n_convs[p] += n_convs[k]
            least[p] = least[k] if least[p] is None else min(least[p], least[k])
            n_children[p] += 1
            n_leaves[p] += n_leaves[k]
            weighed[p] += weighed[k]
            once[p] += once[k]
    edge = set(_path(rows[0][0])) | set(_path(rows[-1][0]))
    for k, name in enumerate(names):
        is_open, p = name in edge, parents[k]
        up_open = p >= 0 and names[p] in edge
        yield {
            "kind": "open" if is_open else "closed",
            "piece": piece,
            "node": name,
            "parent": names[p] if p >= 0 and (is_open or up_open) else None,
            "depth": depths[k],
            "conv_id": least[k],
            "parent_conv_id": None if is_open or up_open or p < 0 else least[p],
            "n_convs": n_convs[k],
            "n_children": n_children[k],
            "n_leaves": n_leaves[k],
            "weighed": weighed[k],
            "once": once[k],
            # Whole nodes have their digest at once, open ones the list itself, bounded by the piece.
            "ends": (_decimals(ends[k]) if ends[k] else None) if is_open else hashlib.sha256(_decimals(ends[k]).encode()).hexdigest(),
        }
    for kind, (ids, lengths, conv_id) in (("first", rows[0]), ("last", rows[-1])):
        yield {"kind": kind, "piece": piece, "conv_id": conv_id, "ids": ids, "chars": lengths}


def shared_twice(last: tuple[list[bytes], list[int]], first: tuple[list[bytes], list[int]]) -> Iterator[dict]:
    """What two neighbouring pieces counted both, as negative sums for the nodes they share."""
    (ids, chars), (others, _) = last, first
    n = 0
    while n < min(len(ids), len(others)) and ids[n] == others[n]:
        n += 1
    names = _path(ids[:n])
    below = 0
    for depth in range(n, -1, -1):
        below += chars[depth - 1] if depth else 0
        yield {
            "node": names[depth],
            "n_children": -1 if depth < n else 0,
            # The last conversation ends in a leaf of its piece, whatever the next piece adds to it.
            "n_leaves": -1 if len(ids) == n else 0,
            "once": -below,
        }


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, rows, turns, part = 0, [], 0, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(list(piece_nodes((part << PLACE_BITS) + place, rows)), _ARROW)

    for batch in batches:
        for conv_id, ids, chars, at in zip(*(c.to_pylist() for c in batch.columns)):
            part = at
            rows.append((ids, chars, conv_id))
            turns += len(ids)
            if len(rows) >= PIECE_CONVERSATIONS or turns >= PIECE_TURNS:
                yield done()
                place, rows, turns = place + 1, [], 0
    if rows:
        yield done()


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.binary()), *((n, pa.int64()) for n in ("n_children", "n_leaves", "once"))])
    for batch in batches:
        for ids, chars, others, lengths in zip(*(c.to_pylist() for c in batch.columns)):
            yield pa.RecordBatch.from_pylist(list(shared_twice((ids, chars), (others, lengths))), schema)


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined lists of each node, which come in order."""
    node, digest, done = None, None, []
    for batch in batches:
        for name, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if name != node:
                if digest is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = name, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends.encode())
        if done:
            yield _digest_rows(done)
            done = []
    if digest is not None:
        yield _digest_rows([(node, digest.hexdigest())])


def _digest_rows(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([n for n, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())],
        names=["node", "ends_sha256"],
    )


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per node for conversations (conv_id, turns), turns an array of (id, chars).

    A node of depth d is a distinct sequence of first d turns; its members are the conversations that
    begin with it, those without a turn too. The columns are conv_id (the smallest member), depth,
    parent_conv_id (the parent's conv_id, null for the root), n_convs, n_children, n_leaves (nodes
    without children in its subtree, itself included), saved_tokens (over its subtree, members less
    one times the code points of a node's last text) and ends_sha256 (SHA-256 of the members with
    exactly d turns, ascending, comma-joined). An empty table has no node. Conversations are expected
    once each, with a conv_id.

    The order is by ids and then conv_id, so many equal conversations are dealt over partitions and
    pieces like any others. What pieces share is one path for each two neighbours.
    """
    spark = sequences.sparkSession
    ids = F.transform("turns", lambda t: t["id"])
    order = (
        sequences.select(F.col("conv_id").cast("long").alias("conv_id"), ids.alias("ids"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
        .repartitionByRange("ids", "conv_id")
        .sortWithinPartitions("ids", "conv_id")
        .withColumn("part", F.spark_partition_id().cast("long"))
    )
    nodes = stored(order.mapInArrow(_pieces, _NODES), "trie")

    # The next piece of each: in the same partition, or the first of the next partition that has any.
    edges = nodes.where("kind in ('first', 'last')").select("kind", "piece", "ids", "chars")
    part = F.shiftright("piece", PLACE_BITS)
    tails = edges.where("kind = 'last'").groupBy(part.alias("part")).agg(F.max("piece").alias("tail"))
    # One row per partition.
    found = sorted((r["part"], r["tail"]) for r in tails.collect())
    leaps = [[tail, after[0] << PLACE_BITS] for (_, tail), after in zip(found, found[1:])]
    ends = edges.where("kind = 'last'").drop("kind")
    if leaps:
        ends = ends.join(small_table(spark, leaps, "piece:bigint,leap:bigint"), "piece", "left")
        ends = ends.withColumn("next", F.coalesce("leap", F.col("piece") + 1))
    else:
        ends = ends.withColumn("next", F.col("piece") + 1)
    starts = edges.where("kind = 'first'").select(F.col("piece").alias("next"), F.col("ids").alias("others"), F.col("chars").alias("lengths"))
    doubled = (
        ends.join(starts, "next")
        .select("ids", "chars", "others", "lengths")
        .mapInArrow(_corrections, "node binary, n_children bigint, n_leaves bigint, once bigint")
    )

    parts = nodes.where("kind = 'open'")
    sums = ("n_children", "n_leaves", "once")
    plain = parts.select("node", "parent", "depth", "conv_id", "n_convs", "weighed", *sums)
    added = (
        plain.unionByName(doubled, allowMissingColumns=True)
        .groupBy("node")
        .agg(
            F.max("parent").alias("parent"),
            F.max("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"),
            F.sum("weighed").alias("weighed"),
            *(F.sum(c).alias(c) for c in sums),
        )
    )
    lists = (
        parts.where("ends is not null")
        .repartition("node")
        .sortWithinPartitions("node", "piece")
        .select("node", "ends")
        .mapInArrow(_joined_digests, "node binary, ends_sha256 string")
    )
    whole = stored(added.join(lists, "node", "left"), "shared")

    result = (
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("weighed") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    closed = nodes.where("kind = 'closed'").withColumn("ends_sha256", F.col("ends"))
    above = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below_open = closed.where("parent is not null").drop("parent_conv_id")
    joined = below_open.select(*(c for c in whole.columns)).unionByName(whole.select(*whole.columns))
    return (
        closed.where("parent is null")
        .select(*result)
        .unionByName(joined.join(apart(above), "parent", "left").select(*result))
    )
