"""BPE encoding and decoding with a public byte-level vocabulary.

Spark splits the texts into words and counts them. Frequent words form a table in which each word is
encoded once; it is bounded, so every task can join it. Other words are encoded once for each batch
of documents they occur in. Ids are put back by position, and decoded by a join with the pieces.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import field, packed, stored, text_or_empty

# Words by which byte-level vocabularies of this kind are split (fixed values), with white space as
# Unicode defines it.
_S = r"\p{IsWhite_Space}"
WORDS = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+"
    rf"|{_S}+(?!\P{{IsWhite_Space}})|{_S}+"
)
# The table of frequent words: how many, and how long a word in it may be, so 16 MB at most.
TABLE_WORDS, TABLE_WORD_CHARS = 1 << 17, 64
# A task counts words until it knows so many, then hands on those it met at least twice.
COUNTED_AT_ONCE, LEAST_IN_TASK = 200_000, 2
# Other words that a task remembers, and documents it encodes at once.
REMEMBERED, ROWS = 100_000, 512


class Vocabulary:
    """A tokenizer file: its library object, its special strings, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.text = file.read()
        spec = json.loads(self.text)
        spec["truncation"] = spec["padding"] = None
        self.text = json.dumps(spec)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        octets = _octets_of_marks()
        pieces: dict[int, bytes] = {i: _piece(p, octets) for p, i in spec["model"]["vocab"].items()}
        pieces.update({i: _piece(p, octets) for p, i in self.specials.items()})
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]

    def encoder(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(self.text)

        def encode(words: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

        return encode


def _octets_of_marks() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def _piece(mark: str, octets: dict[str, int]) -> bytes:
    if all(c in octets for c in mark):
        return bytes(octets[c] for c in mark)
    return mark.encode()


def words_of(text: Column, specials: list[str]) -> Column:
    """The words of a text in order; a special string is a word of its own wherever it stands.

    A text with characters that are unassigned in the JVM's Unicode, and perhaps letters in a newer
    one, stays one word, which the library splits itself when it encodes it.
    """
    whole = text.rlike(r"\p{Cn}")
    plain = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    if not specials:
        return F.when(whole, F.array(text)).otherwise(plain)
    literal = "|".join("".join(f"\\x{{{ord(c):x}}}" for c in s) for s in specials)
    between = F.split(text, literal, -1)
    found = F.regexp_extract_all(text, F.lit(f"({literal})"), F.lit(0))
    parts = F.transform(
        between,
        lambda part, k: F.concat(
            F.regexp_extract_all(part, F.lit(WORDS), F.lit(0)),
            F.when(k < F.size(found), F.slice(found, k + 1, F.lit(1))).otherwise(F.array().cast("array<string>")),
        ),
    )
    return (
        F.when(whole, F.array(text)).when(text.rlike(literal), F.flatten(parts)).otherwise(plain)
    )


def split_words(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, words) per row of ``docs``."""
    texts = packed(docs).select(field("doc_id").alias("doc_id"), text_or_empty().alias("text"))
    return texts.select("doc_id", words_of(F.col("text"), list(vocabulary.specials)).alias("words"))


def word_table(words: DataFrame, vocabulary: Vocabulary, limit: int = TABLE_WORDS) -> DataFrame:
    """(word, ids): the most frequent words, each encoded once.

    Tasks count their words and hand on those they met more than once, so the shuffle holds no words
    that occur once. The least count of a table word comes from a histogram of counts, which has few
    rows; no more than ``limit`` words have it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            often = [(w, n) for w, n in known.items() if n >= LEAST_IN_TASK and len(w) <= TABLE_WORD_CHARS]
            known.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())],
                names=["word", "n"],
            )

        for batch in batches:
            for part in _slices(batch):
                counts = part.column(0).flatten().value_counts()
                known.update(dict(zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist())))
                if len(known) >= COUNTED_AT_ONCE:
                    yield handed_on()
        yield handed_on()

    counted = stored(
        words.select("words").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")),
        "words",
    )
    # Counts in steps of a power of two below a sixteenth: a bounded number of rows for any corpus.
    step = F.floor(F.log2(F.col("n")) * 16).cast("int")
    histogram = counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()
    least, total = 1 << 20, 0
    for row in sorted(histogram, key=lambda r: -r["step"]):
        total += row["words"]
        if total > limit:
            break
        least = row["step"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            ids = encoder(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"]
            )

    return counted.where(step >= least).select("word").mapInArrow(encode, "word string, ids array<int>")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, ROWS):
        yield batch.slice(start, ROWS)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The runs ``flat[starts[i] : starts[i] + sizes[i]]`` for all ``i`` of ``index``, one after the other."""
    n = sizes[index]
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[at + np.repeat(starts[index] - (ends - n), n)]


def encode(docs: DataFrame, vocabulary: Vocabulary, limit: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, ids) per row of ``docs``: the ids of its whole text.

    A null or empty text has no ids. Special strings in a text have their special ids, as the
    library gives them. Rows that repeat get a row each; a null doc_id stays null. Further columns
    are ignored, and an empty table gives no row.

    Texts and words stay where they are read: only counts of words are shuffled. The driver passes
    on the bounded table of frequent words.
    """
    words = split_words(docs, vocabulary)
    run = _encoding(vocabulary, _shared_table(words, vocabulary, limit))
    doc_id = words.schema["doc_id"].dataType.simpleString()
    return words.mapInArrow(run, f"doc_id {doc_id}, ids array<int>")


def _shared_table(words: DataFrame, vocabulary: Vocabulary, limit: int):
    """The table of frequent words on every executor, ids as bytes of :func:`_width`."""
    table = word_table(words, vocabulary, limit).toArrow()
    runs = [np.array(ids, _width(vocabulary)).tobytes() for ids in table.column("ids").to_pylist()]
    return words.sparkSession.sparkContext.broadcast((table.column("word").to_pylist(), runs))


def _width(vocabulary: Vocabulary) -> type:
    return np.uint16 if len(vocabulary.pieces) <= 1 << 16 else np.uint32


def _encoding(vocabulary: Vocabulary, table):
    """Batches (doc_id, words) to (doc_id, ids): each distinct word is looked up or encoded once."""
    width = _width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        known = dict(zip(*table.value))
        remembered: dict[str, bytes] = {}
        for batch in batches:
            for part in _slices(batch):
                column = part.column(1)
                spelled = column.flatten().dictionary_encode()
                distinct = spelled.dictionary.to_pylist()
                runs = [known.get(w) or remembered.get(w) for w in distinct]
                new = [k for k, r in enumerate(runs) if r is None]
                if len(remembered) + len(new) > REMEMBERED:
                    remembered.clear()
                for k, ids in zip(new, encoder([distinct[k] for k in new])):
                    runs[k] = np.array(ids, width).tobytes()
                    if len(remembered) < REMEMBERED and len(distinct[k]) <= TABLE_WORD_CHARS:
                        remembered[distinct[k]] = runs[k]
                flat = np.frombuffer(b"".join(runs), width)
                sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // flat.itemsize
                index = spelled.indices.to_numpy()
                ids = _gather(flat, np.cumsum(sizes) - sizes, sizes, index)
                # Offsets of documents in words become offsets in ids.
                offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
                ends = np.r_[0, np.cumsum(sizes[index])][offsets]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return run


def _decoding(vocabulary: Vocabulary):
    """Batches (doc_id, ids) to (doc_id, ids, text): ids joined with their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
        sizes = np.fromiter(map(len, vocabulary.pieces), np.int64, len(vocabulary.pieces))
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            texts = []
            for ids in _lists(batch.column(1)):
                texts.append(_gather(flat, starts, sizes, ids).tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"]
            )

    return run


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy()
    for low, high in zip(offsets[:-1], offsets[1:]):
        yield values[low:high]


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, text): ids joined with their pieces, whose bytes are read as UTF-8.

    Bytes that are no UTF-8 become replacement characters. The table of pieces is the vocabulary.
    """
    doc_id = encoded.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, ids array<int>, text string"
    return encoded.select("doc_id", "ids").mapInArrow(_decoding(vocabulary), schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, limit: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): :func:`encode`, then :func:`decode`, and digests.

    The steps run one after the other in one Python worker per task, which saves the ids a way
    through the JVM and the executor the memory of further workers.
    """
    words = split_words(docs, vocabulary)
    encoding = _encoding(vocabulary, _shared_table(words, vocabulary, limit))
    decoding = _decoding(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decoding(encoding(batches)):
            ids = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in _lists(batch.column(1))]
            texts = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "ids", "ids_sha256", "decoded_sha256"],
            )

    doc_id = words.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, ids array<int>, ids_sha256 string, decoded_sha256 string"
    coded = words.mapInArrow(run, schema)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "ids_sha256", "decoded_sha256")
