"""Mixing sources to target weights: each document a whole number of times, plus one seeded chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.llm.common import WORD, apart, field, packed, stored, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20
# A table of targets up to this size is broadcast; it has one row per source.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 4 << 20


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> tuple[DataFrame, float]:
    """((source, source_size, weight, cap) per source, level) from rows (source, size).

    Sources take the weights in turn, by code point and null last. They share the sum of all sizes
    by weight, none above ``max_repeats`` times its own size; what that leaves over is shared again.
    The target of a source is ``least(cap, weight * level)``. Each sharing is one aggregate over the
    table of sources, and the driver sees three numbers of it; there are no more rounds than sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source, not per document, is numbered here.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    table = stored(
        totals.select(
            "source",
            "source_size",
            F.element_at(cycle, (place % len(weights)) + 1).cast("long").alias("weight"),
            (F.col("source_size") * max_repeats).alias("cap"),
        ),
        "sources",
    )
    whole, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (whole or 0) / (weight or 1), -1
    while True:
        capped = F.col("cap") / F.col("weight") <= level
        n, used, open_weight = table.agg(
            F.count(F.when(capped, 1)),
            F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)),
            F.sum(F.when(~capped, F.col("weight"))),
        ).first()
        if n == full or not open_weight:
            return table, level
        level, full = (whole - used) / open_weight, n


def chance(seed: int) -> Column:
    """A number from 0 to 1 that depends on the seed, doc_id, source and text only."""
    parts = [F.lit(seed), field("doc_id"), field("source"), F.md5(field("text").cast("binary"))]
    key = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / float(1 << 52)


def planned(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """(row, size, source_size, target, copies): how often the mix emits each row of ``docs``.

    Size is the number of words, 0 for a null text. A null source is a source. A row that repeats is
    planned like its first; rows without words are never emitted, as their source's rate counts
    words only if it has any. Further columns stay in ``row``. An empty table gives no row.

    Sums per source are combined before the shuffle. The table of targets has one row per source: it
    is broadcast if its counted size is small, and joined with the hot source split otherwise.
    """
    rows = packed(docs).select("row", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))
    sizes = rows.select(field("source").alias("source"), "size")
    table, level = source_targets(sizes, weights, max_repeats)
    targets = table.select(
        F.col("source").alias("target_source"),
        "source_size",
        F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level))).alias("target"),
    )
    n, size = table.agg(F.count("*"), F.sum(F.octet_length("source"))).first()
    small = n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
    joined = rows.join(
        F.broadcast(targets) if small else apart(targets),
        field("source").eqNullSafe(F.col("target_source")),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    extra = F.when(chance(seed) < rate - whole, 1).otherwise(0)
    return joined.select(
        "row", "size", "source_size", "target", (whole + extra).cast("long").alias("copies")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as :func:`planned` says."""
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    plan = planned(docs, weights, max_repeats, seed)
    return plan.where("copies > 0").select("row", copies.alias("copy")).select("row.*")
