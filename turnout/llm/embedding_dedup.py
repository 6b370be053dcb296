"""Embedding near-dedup with an inverted multi-index: two codebooks, a grid of cells, verified links."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import apart, field, packed, stored
from turnout.llm.graph import components, forest

COSINE = 0.95
# The index is fitted on this many vectors at most, taken by hash; every vector is indexed.
SAMPLE = 8192
MAX_CODES = 256
PER_CELL = 8
# Units of vectors of one length; their numbers begin at this times the length.
UNITS = 1 << 20
# Share of pairs at exactly the least cosine whose cell the traversal must reach.
TARGET_RECALL = 0.995
# Pairs of the sample that are looked at for each block of its rows.
REAL_PAIRS = 20_000
# Cosines so near the threshold are computed again term by term, which is the same from either side.
CLOSE = 1e-9
# Members of one comparison, queries of one comparison, and rows multiplied at once.
BLOCK, QUERY_BLOCK, ROWS = 4096, 65536, 256


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of the two halves of unit vectors, and how far beyond its nearest cell a query looks."""

    first: np.ndarray
    second: np.ndarray
    reach: float
    codes_in_unit: int

    @property
    def units_in_strip(self) -> int:
        return -(-len(self.second) // self.codes_in_unit)

    def costs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves of ``x`` to the codes."""
        half = self.first.shape[1]
        return _squares(x[:, :half], self.first), _squares(x[:, half:], self.second)


def _squares(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1)[None, :]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, whose square may be too large or small."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codebook(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    codes = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        nearest = _squares(x, codes).argmin(1)
        count = np.bincount(nearest, minlength=n)
        total = np.zeros_like(codes)
        np.add.at(total, nearest, x)
        codes[count > 0] = total[count > 0] / count[count > 0, None]
    return codes


def fit(sample: np.ndarray, n_vectors: int, cosine: float = COSINE, recall: float = TARGET_RECALL) -> MultiIndex:
    """An index for ``n_vectors`` from a bounded sample of them.

    The number of codes grows with the table so that a cell holds PER_CELL vectors on average, up to
    MAX_CODES. The reach is measured, not guessed, as what finds the cells of the target share of
    partners: of partners drawn at exactly the least cosine in random directions, of closer ones, and
    of those that the vectors of the sample really have.
    """
    rng = np.random.default_rng(7)
    x = _unit(sample)
    half = x.shape[1] // 2
    n_codes = max(1, min(MAX_CODES, int((n_vectors / PER_CELL) ** 0.5), len(x)))
    first, second = _codebook(x[:, :half], n_codes, rng), _codebook(x[:, half:], n_codes, rng)
    per_strip = n_vectors / n_codes
    in_unit = max(1, min(n_codes, int(n_codes * BLOCK / max(1, per_strip))))
    index = MultiIndex(first, second, 0.0, in_unit)
    a, b = index.costs(x)
    least = a.min(1) + b.min(1)
    rows = np.arange(len(x))
    reach = 0.0
    for near in (cosine, (1 + 3 * cosine) / 4, (3 + cosine) / 4):
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        length = np.linalg.norm(noise, axis=1, keepdims=True)
        partner = near * x + (1 - near**2) ** 0.5 * noise / np.where(length > 0, length, 1)
        i, j = (c.argmin(1) for c in index.costs(partner))
        reach = max(reach, float(np.quantile(a[rows, i] + b[rows, j] - least, recall)))
    i, j = a.argmin(1), b.argmin(1)
    real = []
    for start in range(0, len(x), ROWS):
        left, right = np.nonzero(x[start : start + ROWS] @ x.T >= cosine)
        if len(left) > REAL_PAIRS:
            chosen = rng.choice(len(left), REAL_PAIRS, replace=False)
            left, right = left[chosen], right[chosen]
        left = left + start
        real.append(a[left, i[right]] + b[left, j[right]] - least[left])
    real = np.concatenate(real)
    other = real[real > 0]  # without vectors in the query's own cell
    if len(other):
        reach = max(reach, float(np.quantile(other, recall)))
    return MultiIndex(first, second, reach, in_unit)


def multi_sequence(a: np.ndarray, b: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in order of cost ``a[i] + b[j]`` until it exceeds the least by more than ``reach``."""
    by_a, by_b = a.argsort(), b.argsort()
    sorted_a, sorted_b = a[by_a].tolist(), b[by_b].tolist()
    limit = sorted_a[0] + sorted_b[0] + reach
    heap = [(sorted_a[0] + sorted_b[0], 0, 0)]
    while heap:
        cost, r, s = heapq.heappop(heap)
        if cost > limit:
            return
        yield int(by_a[r]), int(by_b[s])
        if s + 1 < len(sorted_b):
            heapq.heappush(heap, (sorted_a[r] + sorted_b[s + 1], r, s + 1))
        if s == 0 and r + 1 < len(sorted_a):
            heapq.heappush(heap, (sorted_a[r + 1] + sorted_b[0], r + 1, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


_ROUTED = ("unit", "role", "node", "n", "vec", "codes", "home", "seen")


def _router(indexes: dict[int, MultiIndex]):
    """Rows of ``_ROUTED``: a vector as member of its cell, and as query of each unit it visits.

    Vectors of a length have units of their own. ``home`` is the vector's cell, and a member brings
    ``seen``, the cells it visits as a query, so that who looks it up knows whether it looks back.
    """

    def of_one_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
        lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        for length in np.unique(lengths):
            yield int(length), batch.take(pa.array(np.flatnonzero(lengths == length)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, batch in (part for whole in batches for part in of_one_length(whole)):
            index = indexes[length]
            width = len(index.second)
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                a, b = index.costs(_unit(_matrix(part.column(2))))
                source, unit, role, codes, home, seen = [], [], [], [], [], []
                for k in range(part.num_rows):
                    i, j = int(a[k].argmin()), int(b[k].argmin())
                    own = i * width + j
                    cells = list(multi_sequence(a[k], b[k], index.reach))
                    source.append(k)
                    unit.append(i * index.units_in_strip + j // index.codes_in_unit)
                    role.append(0)
                    codes.append([j])
                    home.append(own)
                    seen.append([r * width + s for r, s in cells])
                    visits: dict[int, list[int]] = {}
                    for r, s in cells:
                        visits.setdefault(r * index.units_in_strip + s // index.codes_in_unit, []).append(s)
                    for at, js in visits.items():
                        source.append(k)
                        unit.append(at)
                        role.append(1)
                        codes.append(js)
                        home.append(own)
                        seen.append([])
                taken = part.take(pa.array(source))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(unit, np.int64) + length * UNITS),
                        pa.array(role, pa.int32()),
                        *taken.columns[:3],
                        pa.array(codes, pa.list_(pa.int32())),
                        pa.array(home, pa.int32()),
                        pa.array(seen, pa.list_(pa.int32())),
                    ],
                    names=list(_ROUTED),
                )

    return run


def _cosines(queries: np.ndarray, vectors: np.ndarray, cosine: float) -> np.ndarray:
    """Cosines of unit vectors; whether one reaches the threshold does not depend on who asks."""
    out = queries @ vectors.T
    left, right = np.nonzero(np.abs(out - cosine) < CLOSE)
    out[left, right] = (queries[left] * vectors[right]).sum(axis=1)
    return out


@dataclass(frozen=True)
class _Rows:
    """Members or queries of one comparison."""

    node: np.ndarray
    n: np.ndarray
    vectors: np.ndarray
    codes: list[np.ndarray]
    home: np.ndarray
    seen: list[np.ndarray]

    def part(self, low: int, high: int) -> _Rows:
        return _Rows(*(getattr(self, f.name)[low:high] for f in fields(self)))

    @staticmethod
    def joined(parts: list[_Rows]) -> _Rows:
        whole = []
        for f in fields(_Rows):
            columns = [getattr(p, f.name) for p in parts]
            whole.append(sum(columns, []) if isinstance(columns[0], list) else np.concatenate(columns))
        return _Rows(*whole)


def _verifier(n_codes: int, cosine: float):
    """(u, v, links) from rows (at, length, role, node, n, vec, codes, home, seen) sorted by the first three.

    A link that both ends find is counted by each for itself; one that only the query finds is
    counted for the member too. What a block of queries links is emitted as a forest.
    """

    def block(members: _Rows, cells: np.ndarray, looks: np.ndarray, span: int, queries: _Rows) -> Iterator[tuple]:
        lengths = np.fromiter(map(len, queries.codes), np.int64, len(queries.codes))
        visits = np.zeros((len(queries.node), n_codes), bool)
        visits[np.repeat(np.arange(len(queries.node)), lengths), np.concatenate(queries.codes)] = True
        linked = _cosines(queries.vectors, members.vectors, cosine) >= cosine
        linked &= visits[:, cells] & (queries.node[:, None] != members.node[None, :])
        left, right = np.nonzero(linked)
        if not len(left):
            return
        count = np.bincount(left, members.n[right], len(queries.node)).astype(np.int64)
        found = np.flatnonzero(count)
        yield queries.node[found], None, count[found]
        # Whether the member visits the query's cell and so finds the link itself.
        key = right * span + queries.home[left]
        place = np.minimum(np.searchsorted(looks, key), len(looks) - 1)
        alone = looks[place] != key
        if alone.any():
            count = np.bincount(right[alone], queries.n[left[alone]], len(members.node)).astype(np.int64)
            found = np.flatnonzero(count)
            yield members.node[found], None, count[found]
        # A vector may be a query and a member of one block: it is one node of the forest.
        names, place = np.unique(np.concatenate([queries.node, members.node]), return_inverse=True)
        low, root = forest(len(names), place[left], place[len(queries.node) + right])
        yield names[low], names[root], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, prepared = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, length, role, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            home = batch.column(7).to_numpy(zero_copy_only=False).astype(np.int64)
            new = (length[1:] != length[:-1]) | (at[1:] != at[:-1]) | (role[1:] != role[:-1])
            cuts = np.flatnonzero(np.r_[True, new])
            for start, stop in zip(cuts, np.r_[cuts[1:], len(at)]):
                codes, seen = (_arrays(batch.column(c).slice(start, stop - start)) for c in (6, 8))
                vectors = _unit(_matrix(batch.column(5).slice(start, stop - start)))
                rows = _Rows(node[start:stop], n[start:stop], vectors, codes, home[start:stop], seen)
                if (at[start], length[start]) != current:
                    current, parts, prepared = (at[start], length[start]), [], None
                if role[start] == 0:
                    parts.append(rows)
                    continue
                if not parts:
                    continue
                if prepared is None:
                    members = _Rows.joined(parts)
                    span = n_codes * n_codes
                    sizes = np.fromiter(map(len, members.seen), np.int64, len(members.seen))
                    looks = np.sort(np.repeat(np.arange(len(sizes)), sizes) * span + np.concatenate(members.seen))
                    prepared = members, np.concatenate(members.codes), looks, span
                for low in range(0, stop - start, ROWS):
                    for u, v, links in block(*prepared, rows.part(low, low + ROWS)):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(u, pa.int64()),
                                pa.nulls(len(u), pa.int64()) if v is None else pa.array(v, pa.int64()),
                                pa.nulls(len(u), pa.int64()) if links is None else pa.array(links, pa.int64()),
                            ],
                            names=["u", "v", "links"],
                        )

    return run


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = column.offsets.to_numpy()
    return np.split(flat, offsets[1:-1] - offsets[0])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = TARGET_RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding).

    Links are pairs with a cosine of at least ``cosine`` in double precision, found by visiting the
    cells of an inverted multi-index and verified. A link that one end finds counts for both. A vector
    that is null or zero, or has null or non-finite components, links with nothing. Vectors of different
    lengths do not link; those of each length have an index of their own. Equal vectors are one
    node, combined before the shuffle, and link with each other. Rows are told apart by their vectors: a
    vec_id that comes with two vectors has a row for each, with the links and the component of that
    vector. Rows without a vec_id link like others; a component is named by its smallest vec_id, which
    is null if it has none. Labels and other columns are ignored.

    Crowded cells are compared as grids of blocks of members and queries; no pairs are emitted.
    """
    rows = packed(vectors).select(field("vec_id").alias("vec_id"), field("embedding").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("vec").isNotNull() & finite & F.exists("vec", lambda v: v != 0)
    # A negative zero is a zero, so that equal vectors are grouped together.
    plain = F.transform("vec", lambda v: F.when(v == 0, F.lit(0).cast(rows.schema["vec"].dataType.elementType)).otherwise(v))
    rows = rows.select("vec_id", F.when(usable, plain).alias("vec"))
    nodes = stored(
        rows.where("vec is not null")
        .groupBy("vec")
        .agg(F.min("vec_id").alias("name"), F.count("*").alias("n"))
        .select(F.monotonically_increasing_id().alias("node"), "name", "n", "vec"),
        "vectors",
    )
    # One row per length of vectors, and a bounded sample of one length at a time.
    indexes = {}
    for length, n_nodes in nodes.groupBy(F.size("vec")).count().collect():
        alike = nodes.where(F.size("vec") == length)
        sample = alike.select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).toArrow()
        indexes[length] = fit(_matrix(sample.column(0).combine_chunks()), n_nodes, cosine, recall)
    found = stored(_linked(nodes.drop("name"), indexes, cosine), "links")
    links = found.where("links is not null").groupBy(F.col("u").alias("linked")).agg(F.sum("links").alias("links"))
    classes = components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "member")
    placed = nodes.join(links, F.col("node") == F.col("linked"), "left").join(
        classes, F.col("node") == F.col("member"), "left"
    )
    placed = stored(
        placed.select(
            "name", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("root")
        ),
        "placed",
    )
    names = placed.groupBy(F.col("root").alias("of")).agg(F.min("name").alias("component"))
    of_node = placed.join(apart(names), F.col("root") == F.col("of")).select(F.col("vec").alias("key"), "links", "component")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return rows.join(apart(of_node), F.col("vec") == F.col("key"), "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _linked(nodes: DataFrame, indexes: dict[int, MultiIndex], cosine: float) -> DataFrame:
    vec = nodes.schema["vec"].dataType.simpleString()
    schema = f"unit bigint, role int, node bigint, n bigint, vec {vec}, codes array<int>, home int, seen array<int>"
    routed = stored(nodes.mapInArrow(_router(indexes), schema), "routed")
    # One row per unit, at most MAX_CODES squared for a length, so it may be broadcast.
    units = routed.groupBy(F.col("unit").alias("of")).agg(
        F.ceil(F.count(F.when(F.col("role") == 0, 1)) / BLOCK).cast("int").alias("rows"),
        F.ceil(F.count(F.when(F.col("role") == 1, 1)) / QUERY_BLOCK).cast("int").alias("columns"),
    )
    own = F.xxhash64("node")
    is_member = F.col("role") == 0
    row = F.when(is_member, F.pmod(own, F.greatest("rows", F.lit(1)))).cast("int")
    column = F.when(~is_member, F.pmod(own, F.greatest("columns", F.lit(1)))).cast("int")
    # A member meets every block of queries, a query every block of members.
    places = F.when(
        is_member,
        F.transform(F.sequence(F.lit(0), F.greatest("columns", F.lit(1)) - 1), lambda c: F.struct(row.alias("r"), c.alias("c"))),
    ).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest("rows", F.lit(1)) - 1), lambda r: F.struct(r.alias("r"), column.alias("c")))
    )
    dealt = (
        routed.join(F.broadcast(units), F.col("unit") == F.col("of"))
        .where("rows > 0 and columns > 0")
        .select(F.explode(places).alias("p"), "*")
        .select(F.xxhash64("unit", "p.r", "p.c").alias("at"), F.size("vec").alias("length"), *_ROUTED[1:])
    )
    n_codes = max((len(index.second) for index in indexes.values()), default=1)
    return (
        dealt.repartition("at")
        .sortWithinPartitions("at", "length", "role")
        .mapInArrow(_verifier(n_codes, cosine), "u bigint, v bigint, links bigint")
    )
