"""The pipeline's stages against brute force, each on its own input, and the whole of it."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.tables import documents, prose
from tests.llm.test_near import plain_simhash, smallest_reachable
from turnout.llm import mixing, toxicity
from turnout.llm.common import clear_stored, shared_folder, stored
from turnout.llm.queries import vocabulary_path

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    """Input and output of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF), name))
    return kept


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_documents_keep_their_columns(results):
    assert all(r.columns == results[0].columns for r in results[1:-1])


def test_toxic_documents_go(spark, results):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in rows(results[1])}
    clean = [d for d, toxic in labels.items() if not toxic]
    # This table has some 70 labelled documents to learn from; larger ones lose no clean document.
    assert sum(d not in kept for d in clean) <= 0.02 * len(clean) + 1
    model = toxicity.fit(results[0], spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(results[0], model).where("predicted = 1").collect()}
    assert kept == {r["doc_id"] for r in rows(results[0])} - rejected


def test_one_of_each_group_of_copies_stays(results):
    groups = {}
    for r in rows(results[1]):
        key = re.sub(r"[\x20\x09-\x0D]+", "", r["text"] or "")
        groups.setdefault(key, []).append((-len(r["text"] or ""), r["doc_id"]))
    assert {r["doc_id"] for r in rows(results[2])} == {min(g)[1] for g in groups.values()}


def test_one_of_each_class_of_near_fingerprints_stays(results):
    prints = {r["doc_id"]: plain_simhash(r["text"]) for r in rows(results[2])}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    classes = smallest_reachable(prints, links)
    assert {r["doc_id"] for r in rows(results[3])} == {d for d in prints if classes[d] == d}


def test_the_mix_repeats_what_the_plan_says(results):
    plan = {r.doc_id: r.copies for r in mixing.planned(results[3]).select("row.doc_id", "copies").collect()}
    assert Counter(r["doc_id"] for r in rows(results[4])) == Counter({d: n for d, n in plan.items() if n})


def test_every_text_of_the_mix_is_encoded(results):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    want = []
    for r in rows(results[4]):
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((r["doc_id"], len(ids), ids, digest, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = [tuple(r.values()) for r in rows(results[5])]
    assert sorted(got) == sorted(want)


def test_whole_run_and_its_folder(spark, results):
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, results[5].collect()))
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}"
    clear_stored(spark)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


LONG = prose(40_000, 77)
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one two three"), (4, "one two three"), (4, "another text of its own"), (None, "without an id"),
    (None, "without an id"), (None, None), (5, "é 😀 ͸ <|endoftext|>"), (6, LONG), (7, LONG + " "), (8, LONG + " end"), (9, "x" * 50_000),
]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns of clashing names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = documents(spark, [(k, t, None if n % 3 else "a") for n, (k, t) in enumerate(ODD)], clashing=True).repartition(3)
    out = stage(spark, docs, SF)
    texts = Counter(t or "" for _, t in ODD)
    if name == "bpe":
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(vocabulary_path())
        want = Counter((k, len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in ODD)
        assert Counter((r.doc_id, r.n_tokens) for r in out.collect()) == want
        return
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text or "") for r in out.collect()]
    given = Counter((k, t or "") for k, t in ODD)
    if name == "toxicity":
        assert Counter(kept) == given  # nothing here is toxic
    elif name == "exact_dedup":
        keys = {re.sub(r"[\x20\x09-\x0D]+", "", t) for t in texts}
        assert len(kept) == len(keys) == len({re.sub(r"[\x20\x09-\x0D]+", "", t) for _, t in kept})
        assert (7, LONG + " ") in kept  # of equal texts the one with the most code points
    elif name == "simhash":
        prints = {t: plain_simhash(t) for t in texts}
        names = sorted(set(prints.values()))
        classes = smallest_reachable(names, [(a, b) for a in names for b in names if a < b and (a ^ b).bit_count() <= 3])
        assert len(kept) == len(set(classes.values())) == len({classes[prints[t]] for _, t in kept})
    else:
        assert name == "mixing" and set(kept) <= set(given)
        plan = Counter()
        for r in mixing.planned(docs).select("row.doc_id", "row.text", "copies").collect():
            plan[(r.doc_id, r.text or "")] += r.copies
        assert Counter(kept) == +plan


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, name):
    docs = documents(spark, [], clashing=True)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)
