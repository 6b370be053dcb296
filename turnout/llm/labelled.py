"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import field, packed, stored, text_or_empty


def is_held_out(doc_id: Column) -> Column:
    """Documents that no model learns from: crc32 of the doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def share(seed: int, key: str = "doc_id") -> Column:
    """A number from 0 to 1 from the hash of ``key``."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) / float(1 << 20)


def quotas(counts: dict[str, int], max_rows: int) -> dict[str, float]:
    """The share of each label's documents to take, so that labels have about equal numbers of them.

    A label with fewer documents than an equal part is taken whole, and what it leaves goes to the others.
    """
    shares, room, left = {}, max_rows, len(counts)
    for label, n in sorted(counts.items(), key=lambda item: (item[1], str(item[0]))):
        taken = min(n, room / left)
        shares[label] = taken / n if n else 0.0
        room, left = room - taken, left - 1
    return shares


def sample_of_labels(labels: DataFrame, max_rows: int, by_label: bool = False) -> DataFrame:
    """(doc_id, label): about ``max_rows`` labelled documents at most that may be learned from, by hash.

    A document with several labels counts with the highest. The number of documents is expected, so it
    may be passed by a few standard deviations. With ``by_label`` every label gets an equal part, and a
    rare one all its documents, however large the table is; the driver then gets one count per label.
    """
    usable = labels.where("doc_id is not null and label is not null").where(~is_held_out(F.col("doc_id")))
    single = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    if not by_label:
        n = single.count()
        return single.where(share(11) < min(1.0, max_rows / max(n, 1)))
    counts = {r["label"]: r["count"] for r in single.groupBy("label").count().collect()}
    if not counts:
        return single
    kind = single.schema["label"].dataType
    table = F.create_map(*[F.lit(v) for item in quotas(counts, max_rows).items() for v in item])
    return single.where(share(11) < F.try_element_at(table, F.col("label").cast(kind)))


def sample_texts(
    docs: DataFrame, labels: DataFrame, max_rows: int, by_label: bool = False, label_column: str | None = None
) -> DataFrame:
    """(doc_id, label, text) of the sample, stored: one row per document, so its rows are bounded too.

    Of rows that repeat a doc_id, the one with the least hash of its text is taken; if the labels are
    a column of ``docs``, named by ``label_column``, one that has the document's label.
    """
    chosen = sample_of_labels(labels, max_rows, by_label).withColumnRenamed("doc_id", "labelled")
    texts = packed(docs).select(
        field("doc_id").alias("doc_id"),
        text_or_empty().alias("text"),
        (F.lit(None) if label_column is None else field(label_column)).alias("own"),
    )
    same = F.col("doc_id") == F.col("labelled")
    if label_column is not None:
        same &= F.col("own") == F.col("label")
    joined = texts.join(F.broadcast(chosen), same)
    one = joined.groupBy("doc_id", "label").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text"))).alias("first")
    )
    return stored(one.select("doc_id", "label", F.col("first.text").alias("text")), "sample")
