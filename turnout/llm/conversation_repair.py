"""Conversation structure repair: cheapest edits by a dynamic program over grammar-compressed sequences.

Every conversation becomes a string of symbols, one for the role and fault of each row. Re-Pair turns
pairs that are frequent over all conversations into rules. A symbol stands for a min-plus transfer
matrix between the states of the wanted form; the matrix of a rule is the product of its two parts, is
computed once, bottom-up, and serves all conversations. An entry holds the least cost and the edits
behind it as a rope, which shares the ropes of its parts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import SPACE, field, packed, stored

ROLES, FAULTS = "sua?", ("none", "blank", "duplicate", "truncated")
FIRST_SYMBOL, FIRST_RULE = ord("A"), 0x100
# Costs of the edits, and what a truncated row adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# States of the form (s?(ua)+)?: nothing yet, after s, after u, after a. It may end in the first and last.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT_USER = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}
NEXT = {"s": {START: AFTER_S}, "u": NEXT_USER, "a": {AFTER_U: AFTER_A}, "?": {}}
# Rules that a round of Re-Pair adds at most, and rules and rounds in all. More only save time.
ROUND_RULES, MAX_RULES, ROUNDS = 128, 1024, 10
# Sequences whose repair a task remembers: how many, and how long.
REMEMBERED, REMEMBERED_LENGTH = 50_000, 64

Entry = tuple[int, int] | None  # least cost and rope
Matrix = list[list[Entry]]


def symbol(role: str, fault: str) -> str:
    return chr(FIRST_SYMBOL + ROLES.index(role) * len(FAULTS) + FAULTS.index(fault))


class Ropes:
    """Strings of edits as shared pairs. Rope 0 is empty, ropes 1 to 4 are D, I, K and R."""

    LETTERS = "DIKR"

    def __init__(self) -> None:
        self.parts: list[tuple[int, int] | None] = [None] * 5
        self.known: dict[tuple[int, int], int] = {}
        self.kept = 5

    def letter(self, edit: str) -> int:
        return 1 + self.LETTERS.index(edit)

    def join(self, left: int, right: int) -> int:
        if not left or not right:
            return left or right
        pair = (left, right)
        if pair not in self.known:
            self.known[pair] = len(self.parts)
            self.parts.append(pair)
        return self.known[pair]

    def keep(self) -> None:
        """The ropes so far stay; :meth:`forget` drops those made later."""
        self.kept, self.known = len(self.parts), {}

    def forget(self) -> None:
        del self.parts[self.kept :]
        self.known.clear()

    def less(self, a: int, b: int) -> bool:
        """Whether rope ``a`` comes before ``b`` in ASCII order; parts that both share are not opened."""
        left, right = [a] if a else [], [b] if b else []
        while left and right:
            x, y = left.pop(), right.pop()
            if x == y:
                continue
            if self.parts[x] is None and self.parts[y] is None:
                return x < y
            # The later rope cannot be part of the earlier one, so it is opened first.
            if self.parts[x] is not None and x > y:
                left += self.parts[x][::-1]
                right.append(y)
            else:
                right += self.parts[y][::-1]
                left.append(x)
        return bool(right)

    def text(self, rope: int) -> str:
        out, stack = [], [rope] if rope else []
        while stack:
            x = stack.pop()
            if self.parts[x] is None:
                out.append(self.LETTERS[x - 1])
            else:
                stack += self.parts[x][::-1]
        return "".join(out)


class Repairs:
    """The matrices of all symbols of a grammar; rule ``k`` is the pair of symbols ``rules[k]``."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.ropes = Ropes()
        insert = self.ropes.letter("I")
        # Rows that are put in between: none, u, a, or u and a.
        self.inserts: Matrix = [[(0, 0) if p == q else None for q in range(4)] for p in range(4)]
        for role in "ua":
            for p, q in NEXT[role].items():
                self.inserts[p][q] = (INSERT, insert)
        for p in (START, AFTER_S):
            self.inserts[p][AFTER_A] = (2 * INSERT, self.ropes.join(insert, insert))
        self.matrices: dict[str, Matrix] = {
            symbol(role, fault): self.product(self.inserts, self._edits(role, fault))
            for role in ROLES
            for fault in FAULTS
        }
        for k, (left, right) in enumerate(rules):
            self.matrices[chr(FIRST_RULE + k)] = self.product(self.matrices[left], self.matrices[right])
        self.ropes.keep()

    def _edits(self, role: str, fault: str) -> Matrix:
        """Delete, keep or rerole one row."""
        out: Matrix = [[None] * 4 for _ in range(4)]
        for p in range(4):
            out[p][p] = (DELETE, self.ropes.letter("D"))
        if fault in ("blank", "duplicate"):
            return out
        extra = TRUNCATED if fault == "truncated" else 0
        for new in "ua":
            for p, q in NEXT[new].items():
                out[p][q] = (REROLE + extra, self.ropes.letter("R"))
        for p, q in NEXT[role].items():
            out[p][q] = (extra, self.ropes.letter("K"))
        return out

    def _best(self, row: list[Entry], matrix: Matrix, q: int) -> Entry:
        """The cheapest way from ``row`` through ``matrix`` to state ``q``, ASCII-least among equal ones."""
        ways = [(a, matrix[m][q]) for m, a in enumerate(row) if a is not None and matrix[m][q] is not None]
        if not ways:
            return None
        least = min(a[0] + b[0] for a, b in ways)
        ropes = [self.ropes.join(a[1], b[1]) for a, b in ways if a[0] + b[0] == least]
        best = ropes[0]
        for rope in ropes[1:]:
            if self.ropes.less(rope, best):
                best = rope
        return least, best

    def product(self, a: Matrix, b: Matrix) -> Matrix:
        return [[self._best(row, b, q) for q in range(4)] for row in a]

    def repair(self, sequence: str) -> tuple[int, str]:
        """Least cost and its edits for the symbols of one conversation."""
        at: list[Entry] = [(0, 0), None, None, None]
        for s in rewritten(sequence, self.rules):
            at = [self._best(at, self.matrices[s], q) for q in range(4)]
        at = [self._best(at, self.inserts, q) for q in range(4)]
        # Only deleted rows lead from the start to the start, so the two ends never tie in one rope.
        ends = [e for e in (at[START], at[AFTER_A]) if e is not None]
        cost = min(c for c, _ in ends)
        audit = min(self.ropes.text(rope) for c, rope in ends if c == cost)
        self.ropes.forget()
        return cost, audit


def rewritten(sequence: str, rules: list[str]) -> str:
    """The sequence after every rule in turn has taken the place of its pair, from left to right."""
    for k, pair in enumerate(rules):
        if len(sequence) < 2:
            break
        sequence = sequence.replace(pair, chr(FIRST_RULE + k))
    return sequence


def _marked(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, text) with nulls of role and text as one space.

    ``digest`` names role and text; rows of one turn are ordered by role, then by it.
    """
    rows = packed(turns).select(
        field("conv_id").alias("conv_id"),
        field("turn").alias("turn"),
        F.coalesce(field("role"), F.lit(" ")).alias("role"),
        F.coalesce(field("text"), F.lit(" ")).alias("text"),
    )
    named = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(named, 256)))


def role_fault_sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, sequence, gaps, blank, duplicate, truncated, illegal) per conversation of ``turns``.

    Rows are (conv_id, turn, role, text); further columns are ignored. They are taken by turn, nulls
    first, then by role and a digest of the text, so repeated rows stand side by side. A null role or
    text is one space, a null conv_id a conversation of its own. A row has its first fault only:
    ``blank`` has nothing but white space, ``duplicate`` repeats role and text of an earlier row,
    ``truncated`` does not end in . ! or ? before white space. ``illegal`` counts neighbours whose
    roles' first letters are not su, ua or au, ``gaps`` the turns that are missing between the least
    and the greatest one. An empty table gives no row.

    Only numbers, roles and digests are shuffled. They meet in one row per conversation, as the
    repaired conversation does.
    """
    text = F.col("text")
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    truncated = ~text.rlike(rf"[.!?](?:{SPACE})?\z")
    rows = _marked(turns).select(
        "conv_id",
        F.struct(
            "turn", "role", "digest", F.when(blank, 1).when(truncated, 3).otherwise(0).alias("fault")
        ).alias("t"),
    )
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            offsets = batch.column(1).offsets.to_pylist()
            rows = batch.column(1).values
            columns = [rows.field(k).to_pylist() for k in range(4)]
            for low, high in zip(offsets[:-1], offsets[1:]):
                out.append(_sequence(*(c[low:high] for c in columns)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c)) for c in zip(*out))],
                names=["conv_id", "sequence", "gaps", *FAULTS[1:], "illegal"],
            )

    conv_id = lists.schema["conv_id"].dataType.simpleString()
    return lists.mapInArrow(
        read,
        f"conv_id {conv_id}, sequence string, gaps bigint, blank bigint, duplicate bigint, "
        "truncated bigint, illegal bigint",
    )


def _sequence(turns: list, roles: list[str], digests: list[bytes], faults: list[int]) -> tuple:
    seen: set[bytes] = set()
    symbols, counts, illegal, before = [], [0, 0, 0, 0], 0, None
    for role, digest, fault in zip(roles, digests, faults):
        if fault != 1 and digest in seen:
            fault = 2
        seen.add(digest)
        counts[fault] += 1
        initial = role[0] if role and role[0] in "sua" else "?"
        illegal += before is not None and before + initial not in ("su", "ua", "au")
        before = initial
        symbols.append(symbol(initial, FAULTS[fault]))
    known = [t for t in turns if t is not None]
    gaps = known[-1] - known[0] + 1 - len(set(known)) if known else 0
    return "".join(symbols), gaps, *counts[1:], illegal


def grammar(sequences: DataFrame) -> list[str]:
    """Re-Pair rules for the column ``sequence``: pairs of symbols, earlier rules first.

    A round counts the neighbours in all conversations, weighted by how many have the sequence, and
    turns the most frequent pairs into rules, until no pair occurs twice or there are ``MAX_RULES``. Which
    rules there are changes no result. The driver gets the pairs of a round that become rules.
    """
    distinct = stored(sequences.groupBy("sequence").agg(F.count("*").alias("n")), "sequences")
    rules: list[str] = []
    for _ in range(ROUNDS):
        def pairs(batches: Iterator[pa.RecordBatch], rules=tuple(rules)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts: Counter = Counter()
                for sequence, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    short = rewritten(sequence, rules)
                    for k in range(len(short) - 1):
                        counts[short[k : k + 2]] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["pair", "n"]
                )

        counted = distinct.mapInArrow(pairs, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        room = min(ROUND_RULES, MAX_RULES - len(rules))
        top = counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(room).collect() if room else []
        if not top:
            break
        rules += [r["pair"] for r in top]
    return rules


def plan_repairs(turns: DataFrame) -> DataFrame:
    """The columns of :func:`role_fault_sequences` with ``cost`` and ``audit``, the cheapest edits.

    The audit has one letter per edit in order: K keeps a row, R gives it the role user or assistant
    (3), D deletes it (4; blank rows and duplicates must go), I inserts a row with an empty text (3).
    A truncated row that is not deleted costs 3 more. What is left has roles that begin like
    (s?(ua)+)?, so a row whose role starts otherwise is deleted or gets a new role. Among edits of
    equal cost the ASCII-least audit is taken.
    """
    sequences = stored(role_fault_sequences(turns), "conversations")
    rules = grammar(sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairs = Repairs(rules)
        remembered: dict[str, tuple[int, str]] = {}
        for batch in batches:
            found = []
            for sequence in batch.column("sequence").to_pylist():
                result = remembered.get(sequence)
                if result is None:
                    result = repairs.repair(sequence)
                    if len(sequence) <= REMEMBERED_LENGTH and len(remembered) < REMEMBERED:
                        remembered[sequence] = result
                found.append(result)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
                names=[*batch.schema.names, "cost", "audit"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sequences.schema)
    return sequences.mapInArrow(run, f"{schema}, cost bigint, audit string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(conv_id, position, edit, role, text) of the rows that stay, a list per batch, in order.

    An audit comes before the rows of its conversation. Besides it only one batch is held.
    """
    conv_id, audit, at, position, state = None, "", 0, 0, START

    def put(edit: str, role: str, text: str) -> tuple:
        nonlocal position, state
        state = NEXT[role[0]][state]
        position += 1
        return conv_id, position - 1, edit, role, text

    def wanted() -> str:
        return "assistant" if state == AFTER_U else "user"

    out: list[tuple] = []

    def inserted() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            out.append(put("I", wanted(), ""))
            at += 1

    for batch in batches:
        for key, plan, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if plan is not None:
                inserted()
                conv_id, audit, at, position, state = key, plan, 0, 0, START
                continue
            inserted()
            edit = audit[at]
            at += 1
            if edit != "D":
                out.append(put(edit, role if edit == "K" else wanted(), text))
        yield out
        out = []
    inserted()
    yield out


def _in_order(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, audit, role, text): each conversation's audit, then its rows, all in one partition.

    One plain shuffle of the texts. They run through the task one after the other: a conversation is
    never gathered, however long.
    """
    rows = _marked(turns).withColumn("audit", F.lit(None).cast("string"))
    nothing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema}
    audits = plans.select("conv_id", "audit", *(c for n, c in nothing.items() if n not in ("conv_id", "audit")))
    both = rows.unionByName(audits)
    return (
        both.repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "digest")
        .select("conv_id", "audit", "role", "text")
    )


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the conversations after the edits of ``plans``.

    ``plans`` is :func:`plan_repairs` of the same turns. Positions count from 0. A conversation of
    which nothing stays has no row.
    """
    conv_id = plans.schema["conv_id"].dataType
    schema = f"conv_id {conv_id.simpleString()}, position bigint, edit string, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in _peeked(batches, lambda first: first.schema.field(0).type):
            if kind is None:
                kind = batch
                continue
            if batch:
                yield _columns(batch, [kind, pa.int64(), pa.string(), pa.string(), pa.string()], ["conv_id", "position", "edit", "role", "text"])

    return _in_order(turns, plans).mapInArrow(run, schema)


def repaired_digests(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the ``role:text`` of :func:`repaired_turns`, newline-joined.

    A digest runs over a conversation from its first to its last row, so one task makes it, with the
    rows coming and going. A conversation of which nothing stays has no row.
    """
    conv_id = plans.schema["conv_id"].dataType
    names = ["conv_id", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, digest, of, done = None, None, None, []
        for rows in _peeked(batches, lambda first: first.schema.field(0).type):
            if kind is None:
                kind = rows
                continue
            for key, position, _, role, text in rows:
                if position == 0:
                    if digest is not None:
                        done.append((of, digest.hexdigest()))
                    digest, of = hashlib.sha256(), key
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield _columns(done, [kind, pa.string()], names)
                done = []
        if digest is not None:
            yield _columns([(of, digest.hexdigest())], [kind, pa.string()], names)

    return _in_order(turns, plans).mapInArrow(run, f"conv_id {conv_id.simpleString()}, repaired_sha256 string")


def _peeked(batches: Iterator[pa.RecordBatch], read) -> Iterator:
    """What ``read`` takes from the first batch, then the edited rows of all."""
    first = next(batches, None)
    if first is None:
        return
    yield read(first)

    def all_batches():
        yield first
        yield from batches

    yield from _edited(all_batches())


def _columns(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
