"""Repair of conversations and their prefix trie against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import DATA
from turnout.llm import conversation_repair as repair
from turnout.llm import prefix_trie as trie
from turnout.llm import queries

CLASHING = "conv_id bigint, turn bigint, role string, text string, digest string, audit string, sequence string, turns string, t string, node string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], CLASHING)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_repair(rows):
    """Counts, cost, audit and repaired text of (turn, role, text) rows in order, by a search over whole strings."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def inserted(best):
        for _ in range(2):
            for state, (cost, audit, out) in list(best.items()):
                for role in ("user", "assistant"):
                    new = step.get((state, role[0]))
                    way = (cost + 3, audit + "I", [*out, role + ":"])
                    if new is not None and (new not in best or way[:2] < best[new][:2]):
                        best[new] = way
        return best

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        ways = []
        for state, (cost, audit, out) in inserted(best).items():
            ways.append((state, (cost + 4, audit + "D", out)))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault else 0
            for new_role, price, edit in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                new = step.get((state, new_role[:1]))
                if new is not None:
                    ways.append((new, (cost + price + extra, audit + edit, [*out, f"{new_role}:{text}"])))
        best = {}
        for state, way in ways:
            if state not in best or way[:2] < best[state][:2]:
                best[state] = way
    cost, audit, out = min((w for s, w in inserted(best).items() if s in ("", "a")), key=lambda w: w[:2])
    assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in out))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit), "\n".join(out)


def by_conversation(rows):
    groups = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        groups[conv_id].append((turn is not None, turn or 0, role.encode(), digest, turn, role, text))
    return {c: [r[4:] for r in sorted(g, key=lambda r: r[:4])] for c, g in groups.items()}


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "superuser"]
TEXTS = ["Yes.", "No! ", "what", "", " \n", None, "end?\t", "…", "a. b", "Yes."]


def odd_rows(seed, n):
    rng = random.Random(seed)
    rows = [
        (rng.choice([None, *range(n // 6)]), rng.choice([None, *range(9)]), rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.5 else f"t{rng.randint(0, 40)}.")
        for _ in range(n)
    ]
    return rows + rows[:20]


def test_repair_against_brute_force(spark):
    rows = odd_rows(3, 600)
    rows += [(5000, k, ("user", "assistant")[k % 2], f"turn {k}" + "." * (k % 7 > 0)) for k in range(700)]  # long
    rows += [(6000 + k, t, ("user", "assistant")[t], "same.") for k in range(200) for t in range(2)]  # copies of one
    rows += [(7000, 0, "user", "w" * 300_000 + "."), (7000, 1, "assistant", "é" * 100_000)]
    frame = conversations(spark, rows).repartition(4)
    plans = repair.plan_repairs(frame)
    got = {r.conv_id: r for r in plans.collect()}
    digests = {r.conv_id: r.repaired_sha256 for r in repair.repaired_digests(frame, plans).collect()}
    texts = defaultdict(list)
    for r in repair.repaired_turns(frame, plans).collect():
        texts[r.conv_id].append((r.position, f"{r.role}:{r.text}", r.edit))
    want = by_conversation(rows)
    assert set(got) == set(want)
    for conv_id, group in want.items():
        numbers, out = plain_repair(group)
        r = got[conv_id]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == numbers
        assert digests.get(conv_id, sha("")) == sha(out)
        assert "\n".join(t for _, t, _ in sorted(texts[conv_id])) == out
        assert "".join(e for _, _, e in sorted(texts[conv_id])) == r.audit.replace("D", "")
    assert repair.plan_repairs(frame.limit(0)).count() == 0
    assert repair.repaired_turns(frame.limit(0), plans.limit(0)).count() == 0


SYMBOLS = [repair.symbol(r, f) for r in repair.ROLES for f in repair.FAULTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(SYMBOLS), max_size=14), st.integers(0, 2**32))
def test_rules_change_no_repair(symbols, seed):
    sequence, rng, rules = "".join(symbols), random.Random(seed), []
    plain = repair.Repairs([]).repair(sequence)
    while len(short := repair.rewritten(sequence, rules)) > 1 and len(rules) < 12:
        k = rng.randrange(len(short) - 1)
        rules.append(short[k : k + 2])
    assert repair.Repairs(rules).repair(sequence) == plain


@settings(max_examples=200, deadline=None)
@given(st.text("DIKR", max_size=9), st.text("DIKR", max_size=9), st.integers(0, 2**32))
def test_ropes_compare_like_their_texts(a, b, seed):
    rng, ropes = random.Random(seed), repair.Ropes()

    def built(text):
        if len(text) < 2:
            return ropes.letter(text) if text else 0
        k = rng.randrange(1, len(text))
        return ropes.join(built(text[:k]), built(text[k:]))

    x, y = built(a), built(b)
    assert ropes.text(x) == a and ropes.less(x, y) == (a < b)


def test_grammar_is_shared_by_conversations(spark):
    one = "".join(repair.symbol(r, "none") for r in "uauauaua")
    rows = [(one,)] * 30 + [(one + repair.symbol("u", "truncated"),)] * 3 + [("",)]
    rules = repair.grammar(spark.createDataFrame(rows, "sequence string"))
    assert len(repair.rewritten(one, rules)) == 1
    assert repair.grammar(spark.createDataFrame([("A",), ("",)], "sequence string")) == []


def damaged_rows(rows):
    out = []
    for conv_id, turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv_id, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


@pytest.mark.parametrize("table", ["odd", f"{DATA}/sf0.01"])
def test_registered_repair(spark, folder, table):
    if table == "odd":
        conversations(spark, odd_rows(8, 300) + [(9000 + k, 0, "user", "a.") for k in range(60)]).write.parquet(f"{folder}/conversations.parquet")
        table = folder
    rows = [tuple(r)[:4] for r in spark.read.parquet(f"{table}/conversations.parquet").collect()]
    left = by_conversation(damaged_rows(rows))
    got = queries.op11_repair(spark, table).collect()
    assert sorted((r.conv_id for r in got), key=str) == sorted({r[0] for r in rows}, key=str)
    for r in got:
        numbers, out = plain_repair(left.get(r.conv_id, []))
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (*numbers, sha(out))


def plain_trie(sequences):
    """Nodes of {conv_id: [(name, chars)]} as the contract states them."""
    members = defaultdict(list)
    for conv_id, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv_id)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []

    def below(node):
        stack, found = [node], []
        while stack:
            found.append(stack.pop())
            stack += children[found[-1]]
        return found

    for node, convs in members.items():
        subtree = below(node)
        own = sorted(c for c in convs if len(sequences[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
            sum(not children[n] for n in subtree), sum((len(members[n]) - 1) * n[-1][1] for n in subtree if n),
            sha(",".join(map(str, own))),
        ))
    return sorted(out, key=str)


def ids(sequences):
    """Turns named by numbers as sequences of ids."""
    return [(c, [(hashlib.sha256(str(n).encode()).digest()[: trie.WIDTH], chars) for n, chars in t]) for c, t in sequences.items()]


SEQUENCES = "conv_id bigint, turns array<struct<id: binary, chars: bigint>>"


def random_sequences(seed, n, names, longest):
    rng = random.Random(seed)
    out = {c: [(k, k * 3 + 1) for k in rng.choices(range(names), k=rng.randint(0, longest))] for c in rng.sample(range(-n, 10 * n), n)}
    for c in list(out)[: n // 3]:
        out[c] = [(1, 4), (2, 7), (3, 10)]  # a third are alike
    return out


@pytest.mark.parametrize("size,partitions", [(10_000, 1), (1, 3), (2, 5), (7, 4)])
def test_trie_against_brute_force(spark, monkeypatch, size, partitions):
    monkeypatch.setattr(trie, "PIECE_CONVERSATIONS", size)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        sequences = random_sequences(size, 150, 5, 6) | {77_000: [(k, 3 * k + 1) for k in range(200)], 77_001: [(k, 3 * k + 1) for k in range(199)]}
        frame = spark.createDataFrame(ids(sequences), SEQUENCES)
        got = sorted((tuple(r) for r in trie.prefix_trie(frame).collect()), key=str)
        assert got == plain_trie(sequences)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_little(spark):
    frame = spark.createDataFrame([], SEQUENCES)
    assert trie.prefix_trie(frame).count() == 0
    frame = spark.createDataFrame([(4, []), (3, [])], SEQUENCES)
    assert [tuple(r) for r in trie.prefix_trie(frame).collect()] == [(3, 0, None, 2, 0, 1, 0, sha("3,4"))]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=5), max_size=400, unique_by=tuple))
def test_radix_tree_holds_its_keys(keys):
    """Ids of two bytes, so nodes grow through all layouts and many keys begin others."""
    tree = trie.RadixTree()
    strings = [b"".join(k.to_bytes(2, "big") for k in key) for key in keys]
    for k, key in enumerate(strings):
        tree.insert(key, k)
    found = list(tree.turns(2))
    names = []
    for parent, depth, key, value in found:
        names.append(key[: 2 * depth])
        assert parent == -1 if not depth else names[parent] == key[: 2 * depth - 2]
        assert value is None or strings[value] == key[: 2 * depth]
    assert sorted(names) == sorted({s[: 2 * d] for s in [*strings, b""] for d in range(len(s) // 2 + 1)})
    assert names == sorted(names)
    assert sorted(v for *_, v in found if v is not None) == list(range(len(keys)))


def test_layouts_grow():
    tree = trie.RadixTree()
    kinds = []
    for byte in random.Random(1).sample(range(256), 256):
        tree.insert(bytes([byte, 0]), byte)
        kinds.append(type(tree.root.layout))
    for kind, low, high in ((trie.Sorted4, 0, 4), (trie.Sorted16, 4, 16), (trie.Indexed48, 16, 48), (trie.Direct256, 48, 256)):
        assert set(kinds[low:high]) == {kind}
    assert [v for *_, v in tree.turns(2)][1:] == list(range(256))


def test_registered_trie(spark, folder):
    rng = random.Random(6)
    rows = [
        (c, rng.choice([None, *range(7)]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "", None, "é😀"]))
        for c in [*range(0, 40), *range(100, 130), *range(205, 225), 12345, 0, 100] for _ in range(rng.randint(1, 5))
    ]
    rows += rows[:30] + [(None, 0, "user", "nobody's")]
    conversations(spark, rows).write.parquet(f"{folder}/conversations.parquet")
    ordered = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = role or "", text or ""
        if conv_id is not None:
            ordered[conv_id].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    ordered = {c: [((r[2], r[4]), len(r[4])) for r in sorted(g)] for c, g in ordered.items()}
    sequences = {}
    for c, own in ordered.items():
        h = zlib.crc32(str(c).encode()) % 6
        sequences[c] = ordered.get(c - c % 100, [])[:h] + own[h:]
    got = sorted((tuple(r) for r in queries.op12_prefix_trie(spark, folder).collect()), key=str)
    assert got == plain_trie(sequences)


def test_trie_counts_every_conversation(spark):
    frame = queries.op12_prefix_trie(spark, f"{DATA}/sf0.01")
    n = spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet").select("conv_id").distinct().count()
    root = frame.where("depth = 0").first()
    assert root.n_convs == n and root.parent_conv_id is None
    assert frame.where("n_children = 0").count() == root.n_leaves
    assert frame.agg(F.sum("n_children")).first()[0] == frame.count() - 1
