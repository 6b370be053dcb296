"""Mixing, secrets, sharding, exact dedup and chat on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.tables import documents, prose
from turnout.llm import chat, exact_dedup, mixing, secret_ledger, sharding
from turnout.llm.common import stored

AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, " o\x0bne"), (7, "éa b"),
    (8, "😀 x"), (None, "null id"), (9, "w" * 30000), (10, "w" * 30000 + " "), (4, "one"), (None, None),
]


def test_mixing_gives_targets_and_repeats(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng.randint(1, 60), k), s) for k, s in enumerate(rng.choices(["a", "b", "c", None, "ä"], [60, 3, 20, 20, 5], k=800))]
    docs = documents(spark, rows, clashing=True)
    plan = mixing.planned(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    targets, level = {}, None
    open_, left = set(order), sum(sizes.values())
    while level is None or any(weight[s] * level > 3 * sizes[s] for s in open_):
        if level is not None:
            full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
            left -= sum(3 * sizes[s] for s in full)
            open_ -= full
        level = left / sum(weight[s] for s in open_)
    targets = {s: weight[s] * level if s in open_ else 3 * sizes[s] for s in order}
    for row in plan:
        assert abs(row.target - targets[row.source]) < 1e-6 and row.source_size == sizes[row.source]
        assert int(row.target / row.source_size) <= row.copies <= 3
    taken = Counter()
    for row in plan:
        taken[row.source] += row.copies * row.size
    assert all(abs(taken[s] - targets[s]) < 0.25 * targets[s] for s in order)
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in plan if r.copies})
    assert mixing.mix(docs).columns == docs.columns


def test_mixing_without_rows_or_words(spark):
    assert mixing.planned(documents(spark, [])).count() == 0
    plan = mixing.planned(documents(spark, AWKWARD[:3])).select("size", "copies", "target").collect()
    assert [tuple(r) for r in plan] == [(0, 0, 0.0)] * 3


RULE = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def spans(text):
    found = [(m.start(), 0, m.end()) for m in RULE.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


SECRETS = [
    "", "token=abcdef", "Token: 'abc' token = abcdefg", "secret=token: abcdefgh", "😀é API_KEY=\"" + "f" * 30 + '"',
    "AKIAAKIA" + "B" * 16, "AKIA" + "7" * 15, "0" * 23 + "g" + "a" * 24, "password:password=123456", "toKEN=x" * 400,
    "Key apiſecret=abcdefgh", "passwd=" + "a1" * 5000,
]


def test_secret_spans(spark):
    rows = [(k, t) for k, t in enumerate(SECRETS)] + [(50, None), (51, SECRETS[1]), (None, SECRETS[1])]
    kinds = [r.name for r in secret_ledger.RULES]
    found = secret_ledger.scan(documents(spark, rows, clashing=True)).select("path", secret_ledger.span_list(kinds).alias("s"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((k, spans(t or "")) for k, t in rows), key=str)
    assert secret_ledger.scan(documents(spark, [])).count() == 0


def test_ledger_scans_unseen_pairs_only(spark, folder):
    path = f"{folder}/ledger"
    first = documents(spark, [(1, "token=abcdef"), (2, "token=abcdef"), (3, "none")])
    assert secret_ledger.scan(first, path).where("size(assign) > 0").count() == 2
    ledger = spark.read.parquet(path)
    assert ledger.count() == 2 * 3  # two blobs, three rules
    later = documents(spark, [(1, "token=abcdef"), (4, "secret=123456")])
    assert secret_ledger.scan_unseen(secret_ledger.versions_of(later), ledger).count() == 3
    assert secret_ledger.scan(later, path).where("size(assign) > 0").count() == 2
    assert spark.read.parquet(path).count() == 3 * 3
    newer = secret_ledger.RULES[:2] + (secret_ledger.Rule("hex", 2, "[0-9a-f]{6,}", 0, 6),)
    unseen = secret_ledger.scan_unseen(secret_ledger.versions_of(first), spark.read.parquet(path), newer)
    assert {(r["rule"], r.rule_version) for r in unseen.collect()} == {("hex", 2)}


def test_a_ledger_that_knows_all_moves_no_text(spark, folder):
    path = f"{folder}/ledger"
    docs = documents(spark, [(k, f"token=abcdef{k % 7} " + "x" * 2000) for k in range(50)]).repartition(3)
    secret_ledger.scan(docs, path)
    ledger = spark.read.parquet(path)
    versions = secret_ledger.versions_of(docs)
    again = secret_ledger.scan_unseen(versions, ledger)
    assert again.count() == 0
    assert secret_ledger.scan(docs, path).where("size(assign) = 1").count() == 50
    assert spark.read.parquet(path).count() == 7 * 3
    # Blob ids ask the ledger; texts follow in a join that then has nothing to join.
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("text#") < plan.index("known#")
    unseen = secret_ledger._unseen(versions, ledger, secret_ledger.RULES, ["a", "b", "c"])
    assert "Exchange" in (p := unseen._jdf.queryExecution().executedPlan().toString()) and "text" not in p.split("Exchange")[0]
    half = secret_ledger.scan_unseen(versions, ledger.where("rule <> 'hex'"))
    assert {(r["rule"], len(r.spans)) for r in half.collect()} == {("hex", 0)} and half.count() == 7


def plain_shards(rows, n_shards, virtual_nodes):
    """(doc_id, text, shard, slot) of every row, straight from the ring."""
    nodes = sharding.ring(n_shards, virtual_nodes)
    placed = Counter()
    for doc_id, text in rows:
        data = (text or "").encode()
        key = f"{'' if doc_id is None else doc_id}:{zlib.crc32(data)}:{len(data) + 16}"
        position = int(hashlib.md5(key.encode()).hexdigest()[: sharding.HEX_DIGITS], 16)
        arc = sum(p < position for p, _ in nodes) % len(nodes)
        placed[(arc, position, doc_id is not None, doc_id or 0, len(data) + 16, zlib.crc32(data), doc_id)] += 1
    arc_bytes = Counter()
    for key, n in placed.items():
        arc_bytes[key[0]] += key[4] * n
    pieces = sharding.loads_on_ring(nodes, arc_bytes, n_shards, sharding.SLACK)
    out, used, at = [], Counter(), Counter()
    listed = []
    for key in sorted(placed):
        arc, size = key[0], key[4]
        for _ in range(placed[key]):
            piece, _, _, shard = max(p for p in pieces if p[1] == arc and p[2] <= at[arc])
            at[arc] += size
            listed.append((piece, key[6], size, key[5], shard))
    for piece, doc_id, size, crc, shard in sorted(listed, key=lambda r: r[0]):
        out.append((doc_id, size, crc, shard, used[shard]))
        used[shard] += 1
    return out


def test_shards_and_slots_are_those_of_the_ring(spark, monkeypatch):
    """A third of the rows share a doc_id with texts of their own, another third is one row."""
    monkeypatch.setattr(sharding, "COPIES_AT_ONCE", 7)
    rng = random.Random(6)
    rows = [(k, prose(rng.randint(0, 9), k)) for k in range(150)] + [(3, prose(5, 1000 + k)) for k in range(150)]
    rows += [(-9, "the same")] * 150 + [(None, None), (None, ""), (None, "é")]
    rng.shuffle(rows)
    placed = sharding.assign_shards(documents(spark, rows), n_shards=5, virtual_nodes=8)
    got = sorted((tuple(r) for r in placed.collect()), key=str)
    assert got == sorted(plain_shards(rows, 5, 8), key=str)
    # The hot doc_id is on arcs all around the ring.
    assert placed.where("doc_id = 3").select("shard").distinct().count() == 5


def test_sharding_is_balanced_and_gapless(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng.randint(1, 40), k)) for k in range(3000)] + [(-5, "same")] * 1500 + [(None, None)] * 3
    docs = documents(spark, rows, clashing=True)
    placed = sharding.assign_shards(docs, n_shards=8, virtual_nodes=64).collect()
    assert len(placed) == len(rows)
    load, slots = Counter(), {}
    for row in placed:
        load[row.shard] += row.size
        slots.setdefault(row.shard, []).append(row.slot)
    mean = sum(load.values()) / 8
    largest = max(r.size for r in placed)
    assert len(load) == 8 and all(abs(v - mean) <= 0.001 * mean + 4 * largest for v in load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.assign_shards(docs, n_shards=8, virtual_nodes=64).collect()
    assert sorted(map(str, placed)) == sorted(map(str, again))
    assert sharding.assign_shards(documents(spark, [])).count() == 0
    assert [(r.size, r.text_crc32, r.slot) for r in sharding.assign_shards(documents(spark, [(1, None)])).collect()] == [(16, 0, 0)]


def test_ring_moves_little_and_never_overfills():
    rng = random.Random(2)
    nodes = sharding.ring(10, 64)
    arcs = {a: rng.randint(0, 1000) for a in range(len(nodes))}
    pieces = sharding.loads_on_ring(nodes, arcs, 10, 0.01)
    total = sum(arcs.values())
    load = Counter()
    starts = {}
    for piece, arc, start, shard in pieces:
        starts.setdefault(arc, []).append((start, shard))
    for arc, parts in starts.items():
        ends = [s for s, _ in parts[1:]] + [arcs[arc]]
        for (start, shard), end in zip(parts, ends):
            load[shard] += end - start
    assert sum(load.values()) == total and max(load.values()) <= 1.01 * -(-total // 10) + 1
    own = sum(min(arcs[a], parts[1][0] if len(parts) > 1 else arcs[a]) for a, parts in starts.items() if parts[0][1] == nodes[a][1])
    assert own > 0.8 * total


def test_exact_dedup_against_brute_force(spark):
    long = prose(4000, 5)
    rows = AWKWARD + [(20, long), (21, long.replace(" ", "  ")), (22, long + "x"), (23, long.replace(" ", "\n"))]
    rows += [(100 + k, "copy of many") for k in range(300)]
    got = exact_dedup.find_duplicates(documents(spark, rows, clashing=True)).collect()
    groups = {}
    for doc_id, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", "", text or "")
        groups.setdefault(key, []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    want = []
    for key, members in groups.items():
        keep = min(members)[3]
        sha = hashlib.sha256(key.encode()).hexdigest()
        want += [(m[3], keep, len(members), m[3] == keep, sha) for m in members]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    docs = documents(spark, [r for r in rows if r[0] is not None], clashing=True)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1 if w[1] == 3 else w[1] for w in want if w[1] is not None} - {1} | {
        min((m for m in g if m[3] is not None), default=(0, 0, 0, None))[3] for g in groups.values()
    } - {None}
    assert exact_dedup.find_duplicates(documents(spark, [])).count() == 0


def test_exact_copies_go_row_by_row(spark):
    rows = [(k, f"text {k % 50}") for k in range(80)]
    rows += rows + [(None, f"text {k % 60}") for k in range(120)]  # a batch twice, and rows without an id
    rows += [(7, "text 3"), (7, "of its own"), (None, "without id"), (None, "without  id"), (None, None), (None, "")]
    docs = documents(spark, rows, clashing=True).repartition(5)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    want = [(k, f"text {k}") for k in range(50)] + [(None, f"text {k}") for k in range(50, 60)]
    want += [(7, "of its own"), (None, "without  id")]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted((g for g in got if g[1]), key=str) == sorted(want, key=str)
    assert len(got) == len(want) + 1  # and one of the empty ones


def test_the_recipe_decides(spark, monkeypatch):
    rows = [(1, "one text"), (2, "one  text"), (3, "another")]
    docs = documents(spark, rows)
    assert {r.doc_id: r.keep_id for r in exact_dedup.find_duplicates(docs).collect()} == {1: 2, 2: 2, 3: 3}
    plain = exact_dedup.recipes

    def with_chunks(change):
        monkeypatch.setattr(exact_dedup, "recipes", lambda d: plain(d).withColumn("chunks", F.transform("chunks", change)))
        return {r.doc_id: r.keep_id for r in exact_dedup.find_duplicates(docs).collect()}

    # One id for every chunk: the check and the length still part the texts, as after a collision.
    same_id = with_chunks(lambda c: c.withField("id", F.lit(b"x")))
    assert same_id == {1: 2, 2: 2, 3: 3}
    blind = with_chunks(lambda c: c.withField("id", F.lit(b"x")).withField("check", F.lit(1)).withField("length", F.lit(7)))
    assert blind == {1: 2, 2: 2, 3: 2}


def test_equal_passages_are_cut_into_equal_chunks(spark):
    passage = prose(3000, 9)
    docs = documents(spark, [(1, prose(100, 1) + passage), (2, prose(331, 2) + passage)])
    table = stored(exact_dedup.recipes(docs), "recipes")
    a, b = (set(bytes(c["id"]) for c in r.chunks) for r in table.orderBy("doc_id").collect())
    assert len(a & b) > 0.7 * min(len(a), len(b))
    uses = exact_dedup.chunk_dictionary(table)
    assert uses.where("uses = 2").count() == len(a & b) and uses.where("not verified").count() == 0


CHAT = "conv_id bigint, turn int, role string, text string, turns string, formatted string"
HARD = ["", "\\", "<", "\\l", "</turn>\n", "<turn user>", "<same>", "\\b\\g>", "plain", "😀\n", None]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows = [
        (c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "a>b", None]), "".join(t or "" for t in rng.choices(HARD, k=2)) if rng.random() > 0.1 else None, "x", "y")
        for c in [1, 2, 3, None] * 15
    ]
    frame = spark.createDataFrame(rows, CHAT)
    formatted = chat.format_conversations(frame)
    read = chat.read_back(formatted).withColumn("learned", chat.masked_text(F.col("formatted"), F.col("loss_mask")))
    got = {r.conv_id: r for r in read.collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(
            ((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv),
            key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()),
        )
        assert [(t["role"], t["text"]) for t in got[conv].turns] == [(t[2], t[3]) for t in turns]
        assert got[conv].learned == "".join(t[3] for t in turns if t[2] == "assistant")
        merged = sum(k == 0 or turns[k - 1][2] != t[2] for k, t in enumerate(turns))
        assert got[conv].formatted.count(chat.OPEN) == merged == got[conv].formatted.count(chat.CLOSE)
        for m in got[conv].loss_mask:
            assert 0 <= m["start"] <= m["start"] + m["length"] <= len(got[conv].formatted)
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_long_lists_are_laid_out_whole(spark):
    """Masks and spans of many parts: 700 turns of a conversation, 900 secrets of a text."""
    turns = [(1, k, ("user", "assistant", "assistant")[k % 3], f"<{k}>", None, None) for k in range(700)]
    formatted = chat.format_conversations(spark.createDataFrame(turns, CHAT).repartition(3))
    got = formatted.select("loss_mask", chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("learned")).first()
    assert got.learned == "".join(t[3] for t in turns if t[2] == "assistant")
    assert len(got.loss_mask) == sum(t[2] == "assistant" for t in turns)
    parts = [f"\U0001f600{'x' * (k % 7)} token={'a1' * (2 + k % 3)} " for k in range(900)]
    text = "".join(parts)
    want = [(m.start(), m.end()) for m in re.finditer(r"token=([a1]+)", text) if len(m[1]) >= 6]
    assert len(want) == 600
    spans = secret_ledger.scan(documents(spark, [(1, text)])).first().assign
    assert [(s["start"], s["end"]) for s in spans] == want
