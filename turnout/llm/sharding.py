"""Shards by a consistent-hash ring with bounded loads, with DataFrame functions only."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.llm.common import field, packed, small_table, stored, text_or_empty

SHARDS = 40
VIRTUAL_NODES = 256
SLACK = 0.001
OVERHEAD = 16
# Positions are the first 60 bits of an MD5; a table by their first 12 bits finds a key's arc.
HEX_DIGITS, PREFIX_DIGITS = 15, 3
# Copies of a row that one task writes out at a time.
COPIES_AT_ONCE = 1 << 16


def ring(n_shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise."""
    points = {}
    for shard in range(n_shards):
        for node in range(virtual_nodes):
            digest = hashlib.md5(f"{shard}:{node}".encode()).hexdigest()
            points.setdefault(int(digest[:HEX_DIGITS], 16), shard)
    return sorted(points.items())


def loads_on_ring(
    nodes: list[tuple[int, int]], arc_bytes: dict[int, int], n_shards: int, slack: float
) -> list[tuple[int, int, int, int]]:
    """(piece, arc, from_byte, shard): which bytes of each arc go to which shard.

    Every shard first fills with its own arcs, clockwise, up to ``1 + slack`` times the mean. What
    does not fit continues clockwise to the next virtual node whose shard has room. The work and the
    result depend on the number of virtual nodes, not on the keys.
    """
    total = sum(arc_bytes.values())
    capacity = -(-total // n_shards) * (1 + slack)
    room: dict[int, float] = defaultdict(lambda: capacity)
    taken: list[tuple[int, int, int]] = []
    waiting: list[tuple[int, int]] = []
    for arc, (_, shard) in enumerate(nodes):
        size = arc_bytes.get(arc, 0)
        fits = int(min(size, room[shard]))
        room[shard] -= fits
        if fits or not size:
            taken.append((arc, 0, shard))
        if fits < size:
            waiting.append((arc, fits))
    for arc, start in waiting:
        at = arc
        while start < arc_bytes[arc]:
            at = (at + 1) % len(nodes)
            shard = nodes[at][1]
            fits = int(min(arc_bytes[arc] - start, room[shard]))
            if fits:
                room[shard] -= fits
                taken.append((arc, start, shard))
                start += fits
            elif at == arc:  # a full turn: less than a byte of room is left in every shard
                taken.append((arc, start, shard))
                break
    return [(i, *piece) for i, piece in enumerate(sorted(taken))]


def position(doc_id: Column, text_crc32: Column, size: Column) -> Column:
    """A row's place on the ring, from doc_id, checksum and size, so that rows that share a doc_id are spread."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), text_crc32.cast("string"), size.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("long")


def assign_shards(
    docs: DataFrame,
    n_shards: int = SHARDS,
    virtual_nodes: int = VIRTUAL_NODES,
    slack: float = SLACK,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row of ``docs``.

    A row is hashed from its doc_id and its text's checksum and size to a place on the ring, and belongs
    to the next virtual node.
    Shards hold equal bytes: no more than ``1 + slack`` times the mean, but for the row at the end of
    a piece, as rows are not cut. Size is the text's UTF-8 bytes plus 16; a null text has none. Rows
    that repeat stay apart and get slots of their own; a null doc_id is placed like an empty one.
    Further columns are ignored. An empty table gives no row.

    Only sums per arc reach the driver, one for each virtual node. Running sums are taken within
    arcs, over distinct rows with their counts, so that a row that fills a third of the table is one
    row of a window, and rows of one doc_id with different texts are on arcs all around the ring. Copies
    are written out in parts that are dealt to all tasks. Slots are numbered within pieces of arcs and
    offset by the sizes of pieces.
    """
    spark = docs.sparkSession
    nodes = ring(n_shards, virtual_nodes)
    positions = [p for p, _ in nodes]
    shift = 4 * (HEX_DIGITS - PREFIX_DIGITS)
    prefixes = []
    for prefix in range(16**PREFIX_DIGITS):
        low, high = (bisect_left(positions, x << shift) for x in (prefix, prefix + 1))
        prefixes.append([prefix, low, positions[low:high]])
    arcs = F.broadcast(small_table(spark, prefixes, "prefix: bigint, low: bigint, points: array<bigint>"))

    rows = packed(docs).select(
        field("doc_id").alias("doc_id"),
        (F.octet_length(text_or_empty()) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("position", position(F.col("doc_id"), F.col("text_crc32"), F.col("size")))
    on_ring = rows.join(arcs, F.shiftright("position", shift) == F.col("prefix")).select(
        "doc_id",
        "size",
        "text_crc32",
        "position",
        (
            (F.col("low") + F.size(F.filter("points", lambda p: p < F.col("position")))) % len(nodes)
        ).alias("arc"),
    )
    keys = stored(
        on_ring.groupBy("arc", "position", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n")),
        "keys",
    )
    arc_bytes = {
        r["arc"]: r["bytes"]
        for r in keys.groupBy("arc").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")).collect()
    }
    pieces = loads_on_ring(nodes, arc_bytes, n_shards, slack)
    by_arc = defaultdict(list)
    for piece, arc, start, shard in pieces:
        by_arc[arc].append({"piece": piece, "start": start, "shard": shard})
    places = F.broadcast(
        small_table(
            spark,
            [[arc, parts] for arc, parts in sorted(by_arc.items())],
            "at: bigint, parts: array<struct<piece:bigint,start:bigint,shard:int>>",
        )
    )
    before = (
        Window.partitionBy("arc")
        .orderBy("position", "doc_id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ordered = keys.select(
        "*",
        F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0)).alias("first_byte"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_row"),
    )
    last = F.col("n") - 1
    parted = ordered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES_AT_ONCE).cast("long"))).alias("copy"))
    up_to = F.least(last, F.col("copy") + (COPIES_AT_ONCE - 1))
    every = parted.hint("rebalance").withColumn("copy", F.explode(F.sequence("copy", up_to)))
    part = F.element_at(
        F.filter("parts", lambda p: p["start"] <= F.col("first_byte") + F.col("copy") * F.col("size")), -1
    )
    placed = stored(
        every.join(places, F.col("arc") == F.col("at"))
        .withColumn("part", part)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.col("part.shard").alias("shard"),
            F.col("part.piece").alias("piece"),
            (F.col("first_row") + F.col("copy")).alias("row_in_arc"),
        ),
        "placed",
    )
    # One row per piece: bounded by the ring and its overflows, as the pieces are.
    used = placed.groupBy("piece", "shard").agg(F.count("*").alias("n"), F.min("row_in_arc").alias("low"))
    earlier = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = used.select(
        F.col("piece").alias("of"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("low")).alias("offset"),
    )
    return placed.join(F.broadcast(offsets), F.col("piece") == F.col("of")).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row_in_arc") + F.col("offset")).alias("slot")
    )
