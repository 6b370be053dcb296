"""Token counts by the whole-token shortcut: most words are one token, so they need no merging.

Offline, before any text is read, every string of the vocabulary is encoded alone; those that come
out as their own single id are the whole tokens. A word of a text is encoded by itself whatever
stands beside it, so a word that is a whole token counts one, and only other words are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.bpe import Vocabulary, words_of
from turnout.llm.common import field, packed, text_or_empty

# Documents a task looks at together, merged words it remembers, and how long such a word may be.
ROWS, REMEMBERED, REMEMBERED_CHARS = 512, 200_000, 64


def whole_tokens(vocabulary: Vocabulary) -> list[str]:
    """The vocabulary's strings that are proven to be one token: alone they are encoded as their own id.

    The proof runs the library's merges on each string. Pieces whose bytes are no UTF-8 are no text
    and cannot be a word; a string that merges stop short of, or that is split, is left out.
    """
    strings = {}
    for token, octets in enumerate(vocabulary.pieces):
        try:
            strings[token] = octets.decode()
        except UnicodeDecodeError:
            continue
    ids = vocabulary.encoder()(list(strings.values()))
    return [s for (token, s), found in zip(strings.items(), ids) if found == [token]]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_whole, over_limit) per row of ``docs``, over its whole text.

    ``n_tokens`` is the length of what the library gives for the text without added special tokens;
    a special string in a text is one token, as by the library's default. ``n_whole`` are the tokens
    that the shortcut counted. A null or empty text has 0 bytes and 0 tokens. Rows that repeat get a
    row each, a null doc_id stays null, further columns are ignored, and an empty table gives no row.

    Nothing is shuffled or collected. The whole tokens go to the executors as one set, which is no
    larger than the vocabulary. A task holds one batch of words at a time.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary))
    texts = packed(docs).select(field("doc_id").alias("doc_id"), text_or_empty().alias("text"))
    words = texts.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        words_of(F.col("text"), list(vocabulary.specials)).alias("words"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = vocabulary.encoder()
        proven = frozenset(whole.value)
        merged: dict[str, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                column = part.column(2)
                spelled = column.flatten().dictionary_encode()
                distinct = spelled.dictionary.to_pylist()
                counts = np.fromiter((w in proven for w in distinct), np.int64, len(distinct))
                rest = np.flatnonzero(counts == 0).tolist()
                unknown = [k for k in rest if distinct[k] not in merged]
                if len(merged) + len(unknown) > REMEMBERED:
                    merged.clear()
                    unknown = rest
                fresh = dict(zip((distinct[k] for k in unknown), map(len, merge([distinct[k] for k in unknown]))))
                index = spelled.indices.to_numpy()
                is_whole = (counts == 1)[index]
                for k in rest:
                    word = distinct[k]
                    counts[k] = fresh[word] if word in fresh else merged[word]
                merged.update((w, n) for w, n in fresh.items() if len(w) <= REMEMBERED_CHARS)
                # Words of a document are adjacent, so sums are differences of running sums.
                offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
                tokens, shortcut = (
                    np.diff(np.r_[0, np.cumsum(values)][offsets]) for values in (counts[index], is_whole)
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(tokens, pa.int64()), pa.array(shortcut, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens", "n_whole"],
                )

    doc_id = words.schema["doc_id"].dataType.simpleString()
    counted = words.mapInArrow(run, f"doc_id {doc_id}, n_bytes bigint, n_tokens bigint, n_whole bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
