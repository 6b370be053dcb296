"""Small hand-made tables for the operators."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns whose names operators might use themselves.
CLASHING = ", row string, size string, fp string, node string, kept string, copies string, component string"


def documents(spark, rows, clashing=False):
    """Documents from (doc_id, text) or (doc_id, text, source); optionally with names that clash."""
    full = [
        (r[0], r[1], "en", r[2] if len(r) > 2 else "a", None) + (("x",) * 7 if clashing else ())
        for r in rows
    ]
    return spark.createDataFrame(full, DOCS + (CLASHING if clashing else ""))


def prose(n: int, seed: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(n))
