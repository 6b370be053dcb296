"""Toxicity: boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm import boosting
from turnout.llm.common import field, packed, text_or_empty
from turnout.llm.labelled import is_held_out, sample_texts, share

# The model is fitted on about this many labelled documents at most, taken by hash.
MAX_TRAINING_ROWS = 8000
CALIBRATION_SHARE = 0.3
# Stems of a word of these lengths may enter the learned lexicon, besides the word itself.
STEMS = (4, 5, 6)
CHANCE_ENTRIES = 0.05
MEMO_WORDS = 200_000

# Insults that need no learning, for a caller to replace, and pronouns of the second person in four languages.
INSULTS = frozenset(
    "idiot moron stupid dumb scum trash loser pathetic worthless disgusting clown imbecile fool "
    "dummkopf trottel idiote crétin imbécile estúpido tonto".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes tuyo vosotros".split()
)
NEAR = 3
LEET = str.maketrans("013457@$!|", "oieastasil")
EDGES = " .,;:!?\"'()[]{}<>*_-~`…«»„“”‘’"
LETTERS = re.compile(r"[^\W\d_]+")

FEATURES = (
    "learned_density", "learned_count", "learned_distinct", "insult_density", "insult_count",
    "second_person_density", "hits_near_second_person", "capital_share", "shouted_words",
    "exclamations", "punctuation_share", "obfuscated_density", "obfuscated_hits", "log_words",
    "mean_word_length",
)


def plain(word: str) -> str:
    """A word in lower case without marks around or inside it, look-alike digits and signs read as letters."""
    word = word.strip(EDGES).lower()
    if word.isalpha():
        return word
    if any(c.isalpha() for c in word):
        word = word.translate(LEET)
    return "".join(LETTERS.findall(word))


def stems(word: str) -> set[str]:
    """The word itself (marked by a final space) and its first letters."""
    return {word + " ", *(word[:n] for n in STEMS if len(word) > n)} if word else set()


def _words(text: str) -> list[str]:
    return text.split()


def _capitals(text: str) -> int:
    """Capital letters of the Latin alphabets, counted in pieces so that long texts need little memory."""
    total = 0
    for start in range(0, len(text), 1 << 20):
        c = np.frombuffer(text[start : start + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        total += int(((c - 65 < 26) | ((c - 0xC0 < 0x1F) & (c != 0xD7))).sum())
    return total


@dataclass(frozen=True)
class Lexicon:
    """Learned entries, and insults that are given."""

    entries: frozenset[str]
    insults: frozenset[str] = INSULTS

    def hit(self, word: str) -> str | None:
        """The entry a plain word falls under, the longest stem first."""
        if word + " " in self.entries:
            return word + " "
        for n in reversed(STEMS):
            if len(word) > n and word[:n] in self.entries:
                return word[:n]
        return None


def features(text: str, lexicon: Lexicon, memo: dict) -> list[float]:
    """The dense features of a whole text, in the order of FEATURES."""
    words = _words(text)
    hits: list[int] = []
    pronouns: list[int] = []
    names = set()
    insults = obfuscated = hidden = shouted = letters = 0
    for k, word in enumerate(words):
        known = memo.get(word)
        if known is None:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            core = word.strip(EDGES)
            base = plain(word)
            name = lexicon.hit(base)
            mixed = bool(core) and not core.isalpha() and any(c.isalpha() for c in core)
            insult = base in lexicon.insults
            odd = mixed and (any(c.isdigit() or c in "@$|!*" for c in core))
            known = memo[word] = (
                name, insult, odd, odd and (insult or name is not None), base in SECOND_PERSON,
                len(core) > 1 and core.isupper(), len(base),
            )
        name, insult, odd, under, pronoun, loud, size = known
        if name is not None:
            names.add(name)
        if name is not None or insult:
            hits.append(k)
        insults += insult
        obfuscated += odd
        hidden += under
        shouted += loud
        letters += size
        if pronoun:
            pronouns.append(k)
    near = 0
    at = 0
    for hit in hits:
        while at < len(pronouns) and pronouns[at] < hit - NEAR:
            at += 1
        near += at < len(pronouns) and pronouns[at] <= hit + NEAR
    n = max(1, len(words))
    size = max(1, len(text))
    capitals = _capitals(text)
    marks = sum(text.count(c) for c in "!?.,;:*#@$%&")
    return [
        1000 * len(hits) / n, math.log1p(len(hits)), len(names), 1000 * insults / n, math.log1p(insults),
        1000 * len(pronouns) / n, near, capitals / size, shouted / n, 1000 * text.count("!") / size,
        marks / size, 1000 * obfuscated / n, hidden, math.log1p(len(words)), letters / n,
    ]


def _log_tail(k: int, n: int, p: float) -> float:
    """An upper bound of the log chance of ``k`` or more of ``n`` with rate ``p`` (Chernoff)."""
    if k <= n * p:
        return 0.0
    q = k / n
    rest = (1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0
    return -n * (q * math.log(q / p) + rest)


def learn_lexicon(sample: DataFrame, insults: frozenset[str] = INSULTS) -> Lexicon:
    """Words and stems that toxic documents hold far more often than chance would give.

    Each is counted once per document over the whole sample. An entry must be so unlikely that,
    among all that were counted, less than one in twenty lexicons holds a chance entry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set()
                for word in set(_words(text)):
                    found |= stems(plain(word))
                terms = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), pa.array([int(label)] * len(terms), pa.int32())],
                    names=["term", "label"],
                )

    counted = (
        sample.select(F.col("label").cast("int").alias("label"), "text")
        .mapInArrow(run, "term string, label int")
        .groupBy("term")
        .agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    )
    n_all, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n_toxic or n_toxic == n_all:
        return Lexicon(frozenset(), insults)
    rate = n_toxic / n_all
    frequent = counted.where("k >= 3")
    tested = max(1, frequent.count())
    limit = math.log(CHANCE_ENTRIES / tested)
    # Bounded by the sample: no more entries can pass than its toxic documents have terms.
    rows = frequent.where(F.col("k") > F.col("n") * (3 * rate + 1) / 4).collect()
    return Lexicon(frozenset(r["term"] for r in rows if _log_tail(r["k"], r["n"], rate) < limit), insults)


def featured(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The columns of ``texts`` but ``text``, and ``x``, the features of the whole text."""
    others = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            x = [features(t.as_py(), lexicon, memo) for t in batch.column("text")]
            columns = [batch.column(c) for c in others] + [pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "x"])

    kept = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in others)
    return texts.mapInArrow(run, f"{kept}, x array<double>")


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    trees: boosting.Boosted


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, insults: frozenset[str] = INSULTS
) -> Model:
    """A model from the labelled documents that are not held out; ``labels`` has doc_id and toxic.

    About ``max_rows`` of them at most reach the driver, as features, one row per document. Lexicon and
    trees learn from one fold; the other, of which neither has seen anything, calibrates the scores. Null
    labels are left out. With no labels at all, or of one kind only, every score is the share of toxic
    rows, 0.5 without rows.
    """
    labelled = labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
    sample = sample_texts(docs, labelled, max_rows).withColumn("fold", share(12) < CALIBRATION_SHARE)
    lexicon = learn_lexicon(sample.where(~F.col("fold")), insults)
    rows = featured(sample, lexicon).orderBy("doc_id").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    label = np.array(rows.column("label").to_pylist(), int)
    fold = np.array(rows.column("fold").to_pylist(), bool)
    return Model(lexicon, boosting.fit(x, label, fold))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``, from its whole text alone.

    A null text is empty and gets the score of an empty text. Rows that repeat get a row each; a
    null doc_id is not held out. Further columns are ignored, and an empty table gives no row.
    """
    texts = packed(docs).select(field("doc_id").alias("doc_id"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            x = [features(t.as_py(), model.lexicon, memo) for t in batch.column(1)]
            p = model.trees.probability(np.array(x, float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    doc_id = texts.schema["doc_id"].dataType.simpleString()
    scored = texts.mapInArrow(run, f"doc_id {doc_id}, score double")
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic. Rows stay where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            x = [features(t.as_py() or "", model.lexicon, memo) for t in batch.column("text")]
            p = model.trees.probability(np.array(x, float).reshape(-1, len(FEATURES)))
            yield batch.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)
