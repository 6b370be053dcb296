"""Language ID: averaged embeddings of hashed subwords with a linear softmax, trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import field, packed, text_or_empty
from turnout.llm.labelled import is_held_out, sample_texts, share

MAX_TRAINING_ROWS = 4000
# A training document is learned from in so many windows of its whole text; short, as texts may be.
WINDOW, WINDOWS_A_TEXT = 160, 4
BUCKETS, DIMENSIONS = 1 << 15, 16
SUBWORDS = (1, 2, 3, 4)
EPOCHS, RATE, BATCH = 8, 8.0, 64
CALIBRATION_SHARE = 0.2
# Share of the calibration windows of known languages that may be rejected.
REJECTED_SHARE = 0.01
PIECE = 1 << 18
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def subwords(text: str) -> np.ndarray:
    """Hashed buckets of all windows of 1 to 4 characters of a text in lower case.

    Blanks are characters too, so starts and ends of words differ from their insides.
    """
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for n in SUBWORDS:
        if len(codes) < n:
            break
        h = np.full(len(codes) - n + 1, n * 0x9E3779B97F4A7C15 & (2**64 - 1), np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return np.concatenate(out)


@dataclass(frozen=True)
class Model:
    """Languages, the projection of every bucket on them, and what calibration found."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    sharpness: float
    reject_below: float

    def judge(self, text: str) -> tuple[str, float, bool]:
        """(language, score, rejected). Long texts are averaged piece by piece."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        total, n = np.zeros(len(self.languages)), 0
        for start in range(0, len(text), PIECE):
            ids = subwords(text[start : start + PIECE])
            total += self.logits[ids].sum(0)
            n += len(ids)
        p = _softmax((total / n + self.bias)[None, :] * self.sharpness)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.reject_below)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut_windows(text: str) -> list[str]:
    """The text, or windows at places of the whole text that its own hash draws."""
    if len(text) <= WINDOW:
        return [text]
    places = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass"))).integers(
        0, len(text) - WINDOW + 1, WINDOWS_A_TEXT
    )
    return [text[p : p + WINDOW] for p in places.tolist()]


def _subwords_of(texts: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Subwords of all windows with a letter, and the text each comes from."""
    found = [(subwords(piece), k) for k, pieces in enumerate(texts) for piece in pieces if has_letter(piece)]
    return [ids for ids, _ in found], np.array([k for _, k in found], np.int64)


def train(texts: list[list[str]], labels: list[str], calibration: np.ndarray, seed: int = 5) -> Model:
    """Embeddings and softmax weights by stochastic gradient descent over shuffled small batches.

    ``texts`` has the windows of each text.

    On the calibration texts, a sharpness is then chosen that makes scores match how often they are
    right, and the score below which a text is rejected as of no known language.
    """
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    code = np.searchsorted(languages, labels)
    windows, owner = _subwords_of(texts)
    y = code[owner]
    held = calibration[owner]
    learn = np.flatnonzero(~held) if (~held).any() else np.arange(len(windows))
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights = np.zeros((DIMENSIONS, len(languages)))
    weights += rng.normal(0, 0.1, weights.shape)
    bias = np.zeros(len(languages))
    steps, step = EPOCHS * max(1, -(-len(learn) // BATCH)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(learn)
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            ids = np.concatenate([windows[r] for r in rows])
            n = np.array([len(windows[r]) for r in rows])
            starts = np.cumsum(n) - n
            mean = np.add.reduceat(table[ids], starts) / n[:, None]
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            pull = error @ weights.T / n[:, None]
            weights -= rate * 0.1 * mean.T @ error
            bias -= rate * 0.01 * error.sum(0)
            buckets, place = np.unique(ids, return_inverse=True)
            change = np.zeros((len(buckets), DIMENSIONS))
            np.add.at(change, place, np.repeat(pull, n, axis=0))
            table[buckets] -= rate * 10 * change
    logits = table @ weights
    fold = np.flatnonzero(held) if held.any() else np.arange(len(windows))
    z = np.array([logits[windows[r]].mean(0) + bias for r in fold]).reshape(-1, len(languages))
    best, sharpness = np.inf, 1.0
    for s in np.geomspace(0.25, 16, 25):
        p = _softmax(z * s)[np.arange(len(fold)), y[fold]]
        loss = -np.log(np.maximum(p, 1e-12)).mean() if len(fold) else 0.0
        if loss < best:
            best, sharpness = loss, float(s)
    top = _softmax(z * sharpness).max(1) if len(fold) else np.zeros(1)
    return Model(languages, logits, bias, sharpness, float(np.quantile(top, REJECTED_SHARE)))


def fit(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """A model from text and lang of documents that are not held out and whose lang is known.

    Training is bounded: about ``max_rows`` documents, an equal part of each language and all of a rare
    one, chosen by hash, and of each up to ``WINDOWS_A_TEXT`` windows drawn over its whole text. The
    windows reach the driver. Without any document, every text is ``und``.
    """
    labels = packed(docs).select(field("doc_id").alias("doc_id"), field("lang").alias("label"))
    sample = sample_texts(docs, labels, max_rows, by_label=True, label_column="lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = [cut_windows(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(windows, pa.list_(pa.string()))],
                names=["doc_id", "label", "windows"],
            )

    doc_id = sample.schema["doc_id"].dataType.simpleString()
    cut = sample.mapInArrow(run, f"doc_id {doc_id}, label string, windows array<string>")
    rows = cut.withColumn("fold", share(13) < CALIBRATION_SHARE).orderBy("doc_id").toArrow()
    fold = np.array(rows.column("fold").to_pylist(), bool)
    return train(rows.column("windows").to_pylist(), rows.column("label").to_pylist(), fold)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) per row of ``docs``, from its whole text alone.

    A text that is null or has no letter is ``und`` with score 0. ``rejected`` marks texts whose
    score is below what known languages reach. Rows that repeat get a row each; a null doc_id is not
    held out. Further columns are ignored, and an empty table gives no row.
    """
    texts = packed(docs).select(field("doc_id").alias("doc_id"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [model.judge(t.as_py()) for t in batch.column(1)]
            lang, score, rejected = zip(*judged) if judged else ((), (), ())
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=["doc_id", "lang_pred", "score", "rejected"]
            )

    doc_id = texts.schema["doc_id"].dataType.simpleString()
    judged = texts.mapInArrow(run, f"doc_id {doc_id}, lang_pred string, score double, rejected boolean")
    held_out = is_held_out(F.col("doc_id")).alias("held_out")
    return judged.select("doc_id", held_out, "lang_pred", "score", "rejected")
