"""SimHash near-dedup: fingerprints, bit-sliced comparison in blocks, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import apart, field, identity, numbered, packed, stored, text_or_empty
from turnout.llm.exact_dedup import without
from turnout.llm.graph import components, merged

WORDS = 3
SEED = 42
RADIUS = 3
# A link of at most three bits leaves at least two of five parts of a 64-bit fingerprint untouched,
# so the ten pairs of parts are keys that miss no link.
PARTS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
# A bucket of more fingerprints is compared as pairs of blocks of about this many.
BLOCK = 4096
# Bit planes between two looks at which blocks can be abandoned, and work items handled at once.
PLANES_A_LOOK = 8
ITEMS = 1 << 15
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_digests(text: bytes, words: int, digest) -> list:
    """Digests of all shingles of a UTF-8 text, repeats included; of all its words if they are fewer."""
    tokens = text.lower().split()  # on bytes both concern ASCII only
    if not tokens:
        return []
    join = b" ".join
    return [digest(join(tokens[i : i + words])) for i in range(max(1, len(tokens) - words + 1))]


def simhash(
    text: bytes, words: int = WORDS, seed: int = SEED, n_words: int = 1, distinct: bool = False
) -> np.ndarray:
    """The fingerprint of a UTF-8 text as ``n_words`` words of 64 bits; all 0 for a text without words.

    One word takes XXH64 of the shingles, two take the 128-bit XXH3. A shingle counts as often as it
    stands in the text, or once if ``distinct``.
    """
    if n_words == 1:
        digests = shingle_digests(text, words, lambda b: xxhash.xxh64_intdigest(b, seed))
        hashes = np.array(list(set(digests)) if distinct else digests, "<u8")
    else:
        digests = shingle_digests(text, words, lambda b: xxhash.xxh3_128_digest(b, seed))
        digests = set(digests) if distinct else digests
        hashes = np.frombuffer(b"".join(digests), "<u8")
    hashes = hashes.reshape(-1, n_words)
    ones = np.zeros(64 * n_words, np.int64)
    for start in range(0, len(hashes), ITEMS):
        octets = hashes[start : start + ITEMS].view(np.uint8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprints(
    docs: DataFrame, words: int = WORDS, seed: int = SEED, n_words: int = 1, distinct: bool = False
) -> DataFrame:
    """(doc_id, fp0, ...): the fingerprint of every whole text, its bits in signed longs."""
    names = [f"fp{k}" for k in range(n_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [simhash(t.as_py().encode(), words, seed, n_words, distinct) for t in batch.column(1)]
            bits = np.array(values, np.uint64).reshape(-1, n_words).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(n_words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    texts = packed(docs).select(field("doc_id").alias("doc_id"), text_or_empty().alias("text"))
    doc_id = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {doc_id}, " + ", ".join(f"{n} bigint" for n in names))


def distances_within(
    planes: np.ndarray, valid: np.ndarray, words: np.ndarray, queries: np.ndarray, radius: int = RADIUS
) -> tuple[np.ndarray, np.ndarray]:
    """(item, mask): which members of block ``words[item]`` are within ``radius`` of ``queries[item]``.

    ``planes[b, w]`` holds bit ``b`` of the 64 members of block ``w``; a query is a row of words of
    64 bits. The differing bits of 64 members at once are added up in carry-save counters, one plane
    per binary digit. They start so high that they overflow at ``radius + 1``, and an overflow stays
    set. Items whose members have all passed the radius are abandoned.
    """
    items = np.arange(len(words))
    digits = radius.bit_length()
    start = (1 << digits) - radius - 1
    counters = [np.full(len(words), ALL if start >> d & 1 else 0, np.uint64) for d in range(digits)]
    over = ~valid[words]
    for bit in range(len(planes)):
        query_bit = (queries[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        carry = planes[bit][words] ^ (np.uint64(0) - query_bit)
        for d in range(digits):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        over |= carry
        if bit >= radius and bit % PLANES_A_LOOK == PLANES_A_LOOK - 1:
            alive = over != ALL
            if not alive.all():
                items, words, queries, over = items[alive], words[alive], queries[alive], over[alive]
                counters = [c[alive] for c in counters]
                if not len(items):
                    break
    return items, ~over


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 fingerprints: shape (bits, blocks)."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    by_block = bits.reshape(-1, 64, bits.shape[1]).transpose(2, 0, 1)  # bit, block, member
    return np.packbits(np.ascontiguousarray(by_block), axis=2, bitorder="little").view("<u8")[:, :, 0]


def _links_of_groups(group: np.ndarray, side: np.ndarray, ids: np.ndarray, fps: np.ndarray, radius: int):
    """Links among rows of the same group; rows must be sorted by group.

    ``side`` is 0 in a bucket that is compared with itself. In a pair of blocks it is 1 or 2, and
    only rows of side 2 are looked up among those of side 1.
    """
    n = len(group)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    of_group = np.repeat(np.arange(len(starts)), sizes)
    member = side < 2
    members = np.add.reduceat(member.astype(np.int64), starts)
    blocks = -(-members // 64)
    first_block = np.cumsum(blocks) - blocks
    rank = np.cumsum(member) - 1
    rank = rank - (np.cumsum(members) - members)[of_group]
    slot = (first_block[of_group] * 64 + rank)[member]
    padded = np.zeros((int(blocks.sum()) * 64, fps.shape[1]), np.uint64)
    padded[slot] = fps[member]
    owner = np.full(len(padded), -1)
    owner[slot] = np.flatnonzero(member)
    planes = _planes(padded)
    valid = np.packbits((owner >= 0).reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    # A work item is one looked-up row against one block of 64 of its group.
    asks = np.flatnonzero((side != 1) & (members[of_group] > 0) & (sizes[of_group] > 1))
    per_ask = blocks[of_group[asks]]
    total = np.cumsum(per_ask)
    label = np.arange(n)
    by_block = owner.reshape(-1, 64)
    one_class = np.full(len(by_block), -1)
    at = 0
    while at < len(asks):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + ITEMS, side="right")))
        repeat = per_ask[at:to]
        rows = np.repeat(asks[at:to], repeat)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        words = first_block[of_group[rows]] + within
        at = to
        # Blocks of one class, of which the looked-up row is too, have nothing to add.
        new = one_class[words] != label[rows]
        rows, words = rows[new], words[new]
        if not len(rows):
            continue
        items, masks = distances_within(planes, valid, words, fps[rows], radius)
        hits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, m = np.nonzero(hits)
        left, right = rows[items[i]], owner[words[items[i]] * 64 + m]
        other = label[left] != label[right]
        if other.any():
            # What is linked is kept as classes, never as pairs.
            label = merged(label, left[other], right[other])
            low = np.where(by_block >= 0, label[by_block], n).min(axis=1)
            high = np.where(by_block >= 0, label[by_block], -1).max(axis=1)
            one_class = np.where(low == high, low, -1)
    nodes = np.flatnonzero(label != np.arange(n))
    return ids[nodes], ids[label[nodes]]


def _comparer(n_words: int, radius: int):
    """Links of rows (bucket, side, node, fp0, ...) sorted by bucket; the last bucket waits for the next batch."""

    def links(rows: list[np.ndarray], stop: int) -> pa.RecordBatch:
        fps = np.stack([r[:stop] for r in rows[3:]], axis=1).view(np.uint64)
        u, v = _links_of_groups(rows[0][:stop], rows[1][:stop], rows[2][:stop], fps, radius)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        waiting: list = []
        held = 0
        for batch in batches:
            waiting.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3 + n_words)])
            held += batch.num_rows
            if held < ITEMS:
                continue
            kept = [np.concatenate(c) for c in zip(*([kept] if kept else []), *waiting)]
            waiting, held = [], 0
            last = int(np.searchsorted(kept[0], kept[0][-1]))
            if last:
                yield links(kept, last)
                kept = [r[last:] for r in kept]
        parts = ([kept] if kept else []) + waiting
        if parts:
            kept = [np.concatenate(c) for c in zip(*parts)]
            if len(kept[0]):
                yield links(kept, len(kept[0]))

    return run


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows (bucket, node, ...) with a ``side``: crowded buckets become pairs of blocks of rows.

    Pairs of blocks together compare every two rows of a bucket. Side 0 is compared with itself; of
    two blocks, side 2 is looked up among side 1.
    """
    large = (
        rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block)
        .select(F.col("bucket").alias("large"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    joined = rows.join(apart(large), F.col("bucket") == F.col("large"), "left")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(
            F.xxhash64(F.col("bucket"), F.greatest(own, j), F.least(own, j)).alias("bucket"),
            F.when(j == own, 0).when(j < own, 2).otherwise(1).alias("side"),
        ),
    )
    alone = F.array(F.struct("bucket", F.lit(0).alias("side")))
    others = [c for c in rows.columns if c != "bucket"]
    return joined.select(
        F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(meets)).alias("b"), *others
    ).select("b.bucket", "b.side", *others)


def exact_masks() -> list[tuple[int, ...]]:
    """Bits that form a key: every pair of parts, for links of at most three of 64 bits."""
    bits = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in PARTS]
    return [(a | b,) for a, b in combinations(bits, 2)]


def near_links(
    prints: DataFrame, masks: list[tuple[int, ...]], radius: int = RADIUS, block: int = BLOCK
) -> DataFrame:
    """Links (u, v) that connect the fingerprints (node, fp0, ...) within ``radius`` bits that share a key.

    A fingerprint goes to one bucket per mask, by the bits under it. Buckets that are counted as
    larger than ``block`` are dealt out as pairs of blocks, which together compare everything.
    """
    fps = [f"fp{k}" for k in range(len(masks[0]))]
    keys = [
        F.xxhash64(F.lit(t), *[F.col(fp).bitwiseAND(F.lit(_signed(m))) for fp, m in zip(fps, mask)])
        for t, mask in enumerate(masks)
    ]
    rows = prints.select("node", *fps, F.explode(F.array(*keys)).alias("bucket"))
    dealt = _in_blocks(rows, block).select("bucket", "side", "node", *fps)
    node = dealt.schema["node"].dataType.simpleString()
    return (
        dealt.repartition("bucket")
        .sortWithinPartitions("bucket", fps[0])
        .mapInArrow(_comparer(len(fps), radius), f"u {node}, v {node}")
    )


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _classes(prints: DataFrame) -> DataFrame:
    """(print, component_id) of every fingerprint (fp0, node); the component is its smallest node."""
    classes = components(near_links(prints.where("node is not null"), exact_masks()))
    joined = prints.join(classes.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    return joined.select(F.col("fp0").alias("print"), F.coalesce("component", "node").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) per row of ``docs``.

    Fingerprints that differ in at most three bits are linked; ``component_id`` is the smallest
    doc_id that links reach. Null texts are empty; texts without words have fingerprint zero and are
    linked like others. Equal fingerprints are one node, so copies of any number are one row after a
    map-side combine. Rows that repeat a doc_id share its class. A null doc_id gets its
    fingerprint's class, or null if no other row is in it. Further columns are ignored.
    """
    table = stored(fingerprints(docs, words, seed), "fingerprints")
    of_print = _classes(table.groupBy("fp0").agg(F.min("doc_id").alias("node")))
    return table.join(apart(of_print), F.col("fp0") == F.col("print")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``docs`` with exactly one row of each class of :func:`near_duplicates`, with all its columns.

    Rows are decided about one by one, by numbers stored with them, so a doc_id may be null or
    repeated. The first row by doc_id stays, null last, then by a hash of the row. Texts without words
    are one class, of which one row stays. A class of any size is combined before the shuffle.
    """
    rows = numbered(docs)
    texts = rows.select(identity(rows).alias("doc_id"), field("text").alias("text"))
    table = stored(fingerprints(texts, words, seed), "fingerprints")
    best = table.groupBy("fp0").agg(F.min("doc_id").alias("best"))
    prints = stored(best.select("fp0", F.col("best.row_id").alias("node"), "best"), "prints")
    classes = stored(_classes(prints.select("fp0", "node")), "classes")
    first = (
        prints.join(classes, F.col("fp0") == F.col("print"))
        .groupBy(F.col("component_id").alias("of"))
        .agg(F.min("best").alias("first"))
    )
    # Of a class, the fingerprint of the first row keeps that row and others keep none.
    stays = (
        prints.select("fp0", "best")
        .join(first.select(F.col("first.row_id").alias("stays")), F.col("best.row_id") == F.col("stays"), "left_semi")
        .select(F.col("best.row_id").alias("row_id"))
    )
    gone = table.select(F.col("doc_id.row_id").alias("row_id")).join(
        apart(stays.withColumnRenamed("row_id", "stays")), F.col("row_id") == F.col("stays"), "left_anti"
    )
    return without(rows, gone)
