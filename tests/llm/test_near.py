"""SimHash, similar documents, embeddings, components and BPE against brute force."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.tables import documents, prose
from turnout.llm import bpe, embedding_dedup, graph, simhash
from turnout.llm.queries import vocabulary_path


def smallest_reachable(names, links):
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    names = list(range(400))
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 180)] + [(200, 200)]
    links += [(rng.randint(250, 399), rng.randint(250, 399)) for _ in range(70)]
    frame = spark.createDataFrame(links + links[:50], "u bigint, v bigint")
    want = smallest_reachable(names, links)
    got = {r.node: r.component for r in graph.components(frame).collect()}
    assert got == {n: want[n] for n in got}
    assert set(got) == {n for a, b in links if a != b for n in (a, b)}
    assert graph.components(frame.limit(0)).count() == 0


def plain_simhash(text, words=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = [t for t in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lower).split(" ") if t]
    shingles = [tokens[k : k + words] for k in range(len(tokens) - words + 1)] or ([tokens] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_classes(spark):
    base = prose(300, 1).split()
    rows = [(1, None), (2, ""), (3, "a"), (4, "A b"), (5, "É x\x0by"), (6, " a b c"), (None, "a"), (7, "z " * 40000)]
    rng = random.Random(2)
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(300)] = "other"
        rows.append((100 + k, " ".join(words)))
    rows += [(300 + k, prose(40, k + 10)) for k in range(60)] + [(100, rows[8][1])]
    got = simhash.near_duplicates(documents(spark, rows, clashing=True)).collect()
    prints = {k: plain_simhash(t) for k, t in rows if k is not None}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = smallest_reachable(prints, links)
    assert len(got) == len(rows) and len(links) > 60
    for row in got:
        if row.doc_id is None:
            assert row.component_id == want[3]
        else:
            assert int(row.fingerprint, 16) == prints[row.doc_id] and len(row.fingerprint) == 16
            assert row.component_id == want[row.doc_id]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 20), st.integers(1, 150), st.integers(1, 2), st.integers(0, 2**32))
def test_bit_sliced_distances(radius, n, n_words, seed):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 2**64, (n, n_words), np.uint64)
    fps[rng.random(n) < 0.5] = fps[0] ^ (rng.integers(0, 2**64, n_words, np.uint64) & rng.integers(0, 2**64, n_words, np.uint64) & rng.integers(0, 2**64, n_words, np.uint64))
    padded = np.zeros((-(-n // 64) * 64, n_words), np.uint64)
    padded[:n] = fps
    valid = np.packbits(np.arange(len(padded)).reshape(-1, 64) < n, axis=1, bitorder="little").view("<u8")[:, 0]
    words = np.repeat(np.arange(len(padded) // 64), n)
    queries = np.tile(fps, (len(padded) // 64, 1))
    items, masks = simhash.distances_within(simhash._planes(padded), valid, words, queries, radius)
    found = {(int(i % n), int(words[i]) * 64 + b) for i, m in zip(items, masks) for b in range(64) if int(m) >> b & 1}
    distance = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2)
    assert found == {(a, b) for a, b in zip(*np.nonzero(distance <= radius))}


@pytest.mark.parametrize("block", [8, 4096])
def test_crowded_buckets_lose_no_link(spark, block):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63, 150)]
    fps += [fps[k % 20] ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) for k in range(150)]
    fps = sorted(set(fps))
    frame = spark.createDataFrame(list(enumerate(fps)), "node bigint, fp0 bigint")
    links = simhash.near_links(frame, simhash.exact_masks(), block=block)
    want = smallest_reachable(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 3])
    got = smallest_reachable(range(len(fps)), [(r.u, r.v) for r in links.collect()])
    assert got == want and len(set(want.values())) < len(fps)


def test_near_rows_go_row_by_row(spark):
    rng = random.Random(9)
    rows = []
    for k in range(12):
        words = prose(300, 7000 + k).split()
        for n in range(8):
            near = list(words)
            near[rng.randrange(300)] = f"other{n % 3}"
            rows.append((k % 10, " ".join(near)))  # ids repeat, some with texts of two classes
    rows += rows[:30]  # a batch twice
    rows += [(None, rows[0][1]), (None, prose(60, 1)), (None, prose(60, 1)), (500, None), (501, ""), (502, " \n")]
    docs = documents(spark, rows, clashing=True).repartition(5)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    prints = [plain_simhash(t) for _, t in rows]
    distinct = sorted(set(prints))
    links = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3]
    classes = smallest_reachable(distinct, links)
    want, got = {}, {}
    for (doc_id, _), print_ in zip(rows, prints):
        best = want.setdefault(classes[print_], doc_id)
        if doc_id is not None and (best is None or doc_id < best):
            want[classes[print_]] = doc_id
    for r in kept.collect():
        of = classes[plain_simhash(r.text)]
        assert of not in got
        got[of] = r.doc_id
    assert got == want and len(links) > 20
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


VECTORS = "vec_id bigint, embedding array<float>, label int, node string, vec string, links string"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 0, "x", "y", "z") for k, v in rows], VECTORS)


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 16))
    for k in range(300, 900):
        x[k] = x[k % 40] + rng.normal(size=16) * rng.choice([0.02, 0.07, 0.09])
    x = x.astype(np.float32)
    rows = [(k, [float(v) for v in x[k]]) for k in range(900)] + [(2000 + k, [float(v) for v in x[3] * 1]) for k in range(30)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0] * 15), (1005, [float("inf")] * 16), (1006, [])]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors(spark, rows + odd)).collect()}
    ids = np.array([k for k, _ in rows])
    full = np.array([v for _, v in rows], float)
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    linked = full @ full.T >= 0.95
    np.fill_diagonal(linked, False)
    want = smallest_reachable(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(linked))])
    counts = np.array([got[k].n_links for k in ids])
    assert (counts <= linked.sum(1)).all() and counts.sum() >= 0.98 * linked.sum()
    assert np.mean([got[k].component_id == want[k] for k in ids.tolist()]) > 0.98
    for k, _ in odd:
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0
    assert embedding_dedup.near_duplicates(vectors(spark, odd)).where("kept").count() == len(odd)


def test_vectors_of_every_length_are_compared(spark):
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for at, (length, n) in enumerate([(1, 6), (8, 40), (16, 700), (24, 30), (700, 1)]):
        x = rng.normal(size=(n, length))
        x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, length)) * 0.02
        x = x.astype(np.float32)
        ids = [1000 * at + k for k in range(n)]
        rows += [(k, [float(c) for c in v]) for k, v in zip(ids, x)]
        full = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        linked = full @ full.T >= 0.95
        classes = smallest_reachable(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked))])
        want |= {k: (int(linked[i].sum()) - 1, classes[k]) for i, k in enumerate(ids)}
    random.Random(1).shuffle(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert {k: got[k] for k in got if k // 1000 != 2} == {k: want[k] for k in want if k // 1000 != 2}
    assert np.mean([got[k] == want[k] for k in want]) > 0.99


def test_a_vec_id_may_have_two_vectors(spark):
    e = np.eye(4)
    near = [(v + 0.01 * e[(k + 1) % 4]) for k, v in enumerate(e)]
    rows = [(1, e[0]), (2, near[0]), (1, e[1]), (3, near[1]), (4, e[1] + 0.005), (None, e[2]), (5, near[2]), (None, e[3]), (None, e[3])]
    got = embedding_dedup.near_duplicates(vectors(spark, [(k, [float(c) for c in v]) for k, v in rows])).collect()
    want = [(1, 1, 1), (2, 1, 1), (1, 2, 1), (3, 2, 1), (4, 2, 1), (None, 1, 5), (5, 1, 5), (None, 1, None), (None, 1, None)]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(want, key=str)


def test_huge_and_tiny_vectors_keep_their_direction(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1.01e-300]), (3, [1e200, -1e200]), (4, [-0.0, 2.0]), (5, [0.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4)}


@pytest.mark.parametrize("reach", [0.0, None])
def test_links_count_for_both_ends(spark, monkeypatch, reach):
    """Also links that one end alone reaches: with no reach at all, many are found from one side only."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(1500, 24))
    noise = rng.normal(size=(700, 24))
    unit = x[:700] / np.linalg.norm(x[:700], axis=1, keepdims=True)
    noise -= (noise * unit).sum(1, keepdims=True) * unit
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    near = rng.uniform(0.9505, 0.97, (700, 1))
    x[700:1400] = near * unit + (1 - near**2) ** 0.5 * noise
    if reach is not None:
        plain = embedding_dedup.fit
        monkeypatch.setattr(embedding_dedup, "fit", lambda *a: replace(plain(*a), reach=0.02))
    rows = [(k, [float(v) for v in x[k]]) for k in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    linked = [r for r in got.values() if r.n_links]
    pairs = sum(got[k].n_links == 1 and got[k + 700].n_links == 1 for k in range(700))
    assert sum(r.n_links for r in linked) == 2 * pairs == len(linked)
    assert all(got[k].n_links == got[k + 700].n_links and (got[k + 700].component_id == k) == bool(got[k].n_links) for k in range(700))
    assert pairs >= 0.99 * 700 if reach is None else 0 < pairs < 700


def test_cells_come_in_order_of_cost():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(9)
    cells = list(embedding_dedup.multi_sequence(a, b, 0.6))
    costs = [a[i] + b[j] for i, j in cells]
    assert costs == sorted(costs) and len(set(cells)) == len(cells)
    assert set(cells) == {(i, j) for i in range(7) for j in range(9) if a[i] + b[j] <= a.min() + b.min() + 0.6}


@pytest.mark.parametrize("blocks", [(8, 16), (4096, 65536)])
def test_crowded_cells_are_compared_whole(spark, monkeypatch, blocks):
    monkeypatch.setattr(embedding_dedup, "BLOCK", blocks[0])
    monkeypatch.setattr(embedding_dedup, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(4)
    x = np.ones((120, 8)) + rng.normal(size=(120, 8)) * 0.02
    rows = [(k, [float(v) for v in np.float32(x[k])]) for k in range(120)]
    got = embedding_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert {r.component_id for r in got} == {0}
    assert max(r.n_links for r in got) == 119 and sum(r.n_links for r in got) >= 0.99 * 120 * 119


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(vocabulary_path())


TEXTS = [
    None, "", " ", "  a  b ", "it's we'll I'M 12三x²", " 　x \n\n y\x85", "<|endoftext|>", "a!<|endoftext|> b  <|endoftext|>",
    "<|endoftext", "naïve 😀👩‍👩‍👧 über", "x" * 5000, " " * 3000 + "z", "\t\r\n\x0b\x0c", "'s't're", "é ​ ﻿", "٣٤ ½ Ⅷ _-_", "new \U0001df00\U0001df01 letters <|endoftext|>\u0378 ",
]


def test_bpe_is_the_library(spark, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    rows = list(enumerate(TEXTS)) + [(None, "null id"), (3, TEXTS[3]), (90, prose(30000, 3))]
    docs = documents(spark, rows, clashing=True)
    encoded = bpe.encode(docs, vocabulary, limit=50)
    got = sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str)
    want = sorted(((k, library.encode(t or "", add_special_tokens=False).ids) for k, t in rows), key=str)
    assert got == want
    decoded = sorted(((r.doc_id, r.text) for r in bpe.decode(encoded, vocabulary).collect()), key=str)
    assert decoded == sorted(((k, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for k, t in rows), key=str)
    both = bpe.round_trip(docs, vocabulary).select("doc_id", "ids", F.size("ids").alias("n"), "n_tokens").collect()
    assert sorted(((r.doc_id, r.ids) for r in both), key=str) == want and all(r.n == r.n_tokens for r in both)
    assert bpe.encode(docs.limit(0), vocabulary).count() == 0


def test_bad_bytes_are_replaced(spark, vocabulary):
    ids = spark.createDataFrame([(1, [vocabulary.pieces.index(b"\xe2"), 50256])], "doc_id bigint, ids array<int>")
    assert bpe.decode(ids, vocabulary).first().text == "�<|endoftext|>"
