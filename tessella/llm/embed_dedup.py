"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c.  A fixed
random rotation spreads their energy; the rotated vectors are split into blocks
of few dimensions, each with the part of the squared-distance budget that its
dimensions have of all.  If every block exceeded its part, the sum would exceed
the budget: so each linked pair is within the budget of at least one block.

Each block is range-joined on a grid over its first coordinates: a vector has a
home cell and visits those of the neighbouring cells, in lexicographic order
after its own, that its block's ball touches.  So each pair meets once, in the
home of one of the two.  In a cell, homes meet homes and visitors; a pair within
the block's budget is a candidate, taken only in the first such block, and its
cosine is then verified in double precision from the vectors as given.  No pair
leaves its task: a task returns counts of links, and a spanning forest of them
for the components.  Blocks, grid and cell size follow the dimension and the
number of vectors (:func:`choose_grid`); the links are the same for all.

Equal vectors of a label are joined as one with a multiplicity.  Cells with
more than ``chunk`` vectors are cut by hash, and each pair of parts is a task.
Such a task knows the trees within its parts, which are returned once by the
tasks of a part with itself, and returns one edge only for each two trees that
it joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialise

_SLACK = 1e-9
#: Candidate pairs whose vectors are compared at once: a bound on memory.
PAIRS_AT_ONCE = 32_768


@dataclass(frozen=True)
class Grid:
    """Blocks, dimensions of each block's grid, and sides of its cells in radii."""

    blocks: int
    dims: int
    side: float


#: Fixed by measurement: a visit to a cell costs as much as so many distances.
DISTANCES_A_VISIT = 1000
#: A grid computes no more than this share of a label's ordered pairs, where one can.
MOST_PAIRS = 0.38


def choose_grid(dim: int, cosine: float, rows: int) -> Grid:
    """The cheapest grid for labels of up to ``rows`` vectors, by what random vectors would cost.

    A cell of side s radii in g dimensions is touched by the balls of
    sum(C(g, j) * volume of the unit j-ball / s**j) times as many vectors as
    live in it (Steiner); the share of pairs that meet is estimated on random pairs.
    """
    pairs = np.random.default_rng(7).standard_normal((2, 20_000, 8)) / np.sqrt(dim)
    options = []
    for blocks in sorted({b for b in (2, 3, 4, 6, 8, 12, 16, 24, 32) if dim / 24 <= b <= dim} or {1}):
        size = dim // blocks
        radius = np.sqrt(max(2 - 2 * cosine, 1e-12) * size / dim)
        for g in range(1, min(8, size) + 1):
            for side in (2.0, 3.0, 4.0, 6.0):
                visits = sum(math.comb(g, j) * math.pi ** (j / 2) / math.gamma(j / 2 + 1) / side**j for j in range(g + 1))
                x, y = pairs[0, :, :g] / (side * radius), np.floor(pairs[1, :, :g] / (side * radius))
                gap = np.maximum(0, np.maximum(y - x, x - (y + 1)))
                share = ((gap * gap).sum(axis=1) <= side**-2).mean() * blocks / 2
                options.append((share > MOST_PAIRS, blocks * (visits + 1) / 2 * DISTANCES_A_VISIT + share * rows, Grid(blocks, g, side)))
    return min(options, key=lambda o: o[:2] if not o[0] else (True, o[1]))[2]


class Subspaces:
    """Rotation, blocks and grid for vectors of ``dim`` dimensions."""

    def __init__(self, dim: int, cosine: float, grid: Grid, seed: int = 20):
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
        self.rotation = q * np.sign(np.diag(r))
        self.blocks = [b for b in np.array_split(np.arange(dim), grid.blocks) if len(b)]
        self.budgets = np.array([(2 - 2 * cosine) * len(b) / dim for b in self.blocks]) * (1 + _SLACK) + _SLACK
        self.radii = np.sqrt(self.budgets)
        self.grid = [b[: grid.dims] for b in self.blocks]
        # Keys are exact: each coordinate's cell, from -1 / side - 2 to 1 / side + 2, has a digit of its own.
        digits = [1 << 62 // len(g) for g in self.grid]
        self.side = np.maximum(grid.side * self.radii, [2.0 / (d - 6) if d > 8 else 1.0 for d in digits])
        self.digits = digits
        #: The coordinate of each block that sorts the vectors of a cell.
        self.sort = [b[min(len(g), len(b) - 1)] for b, g in zip(self.blocks, self.grid)]

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.rotation

    def first_block(self, squares: np.ndarray) -> np.ndarray:
        """The first block within its budget, of rows of blockwise squared distances."""
        within = squares <= self.budgets
        return np.where(within.any(axis=1), within.argmax(axis=1), len(self.blocks))

    def squares(self, difference: np.ndarray) -> np.ndarray:
        return np.stack([(difference[:, b] ** 2).sum(axis=1) for b in self.blocks], axis=1)

    def cells(self, rotated: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """``(rows, their cell keys, whether home)`` of a block's grid; visits go forward only."""
        at = rotated[:, self.grid[block]] / self.side[block]
        home = np.floor(at).astype(np.int64)
        reach = (self.radii[block] / self.side[block]) ** 2 * (1 + _SLACK) + _SLACK
        low, high = (at - home) ** 2, (home + 1 - at) ** 2
        half, digits = self.digits[block] // 2, self.digits[block]

        def visit(rows: np.ndarray, gaps: np.ndarray, key: np.ndarray, i: int, ahead: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
            if i == at.shape[1]:
                yield rows, key, not ahead
                return
            for move in (-1, 0, 1) if ahead else (0, 1):
                more = gaps if move == 0 else gaps + (low if move < 0 else high)[rows, i]
                near = np.flatnonzero(more <= reach)
                if len(near):
                    yield from visit(rows[near], more[near], key[near] * digits + home[rows[near], i] + move + half, i + 1, ahead or move > 0)

        yield from visit(np.arange(len(at)), np.zeros(len(at)), np.zeros(len(at), dtype=np.int64), 0, False)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors in double precision, scaled by powers of two, which changes no cosine, so that no square over- or underflows."""
    vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1][:, None])


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _place(cosine: float, grids: dict[int, Grid]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces: dict[int, Subspaces] = {}
        for batch in batches:
            dims = pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
            light = batch.select([0, 1])
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                if dim not in spaces:
                    spaces[dim] = Subspaces(dim, cosine, grids[dim])
                space = spaces[dim]
                rotated = space.rotated(_unit(_matrix(batch.column(2).take(pa.array(rows)))))
                for block in range(len(space.blocks)):
                    parts = list(space.cells(rotated, block))
                    pick = light.take(pa.array(rows[np.concatenate([found for found, _, _ in parts])]))
                    home = np.concatenate([np.full(len(found), home) for found, _, home in parts])
                    n = len(home)
                    yield pa.RecordBatch.from_arrays(
                        [*pick.columns, pa.array(np.full(n, dim)), pa.array(np.full(n, block)), pa.array(np.concatenate([key for _, key, _ in parts])), pa.array(home)],
                        names=["id", "label", "dim", "block", "cell", "home"],
                    )

    return run


def near_in_block(values: np.ndarray, sort: np.ndarray, budget: float, one: np.ndarray, two: np.ndarray | None = None, at_once: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Pairs of rows of ``one`` and ``two`` within ``budget``, and how many distances that took.

    Without ``two``, each unordered pair of ``one`` once.  Rows are sorted by
    one more coordinate, ``sort``: those beyond the radius are not compared.
    """
    radius = np.sqrt(budget) * (1 + _SLACK) + _SLACK
    one = one[np.argsort(sort[one], kind="stable")]
    other = one if two is None else two[np.argsort(sort[two], kind="stable")]
    at, size = sort[other], (values * values).sum(axis=1)
    for i in range(0, len(one), at_once):
        p = one[i : i + at_once]
        low = i if two is None else int(np.searchsorted(at, sort[p[0]] - radius, "left"))
        q = other[low : int(np.searchsorted(at, sort[p[-1]] + radius, "right"))]
        near = size[p, None] + size[None, q] - 2 * values[p] @ values[q].T <= budget + 1e-9
        if two is None:
            near &= np.arange(len(q)) > np.arange(len(p))[:, None]
        a, b = np.nonzero(near)
        yield p[a], q[b], len(p) * len(q) - (len(p) * (len(p) + 1) // 2 if two is None else 0)


class _Links:
    """Verified links of one task's rows in one block, their counts and forest."""

    def __init__(self, space: Subspaces, block: int, cosine: float, vectors: np.ndarray, ids: np.ndarray, copies: np.ndarray):
        self.space, self.block, self.cosine = space, block, cosine
        self.vectors, self.ids, self.copies = vectors, ids, copies
        self.rotated = space.rotated(_unit(vectors))
        self.part = self.rotated[:, space.blocks[block]]
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.counts = np.zeros(len(ids), dtype=np.int64)
        self.root = np.arange(len(ids))
        self.edges: list[np.ndarray] = []

    def links(self, one: np.ndarray, two: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for all_a, all_b, _ in near_in_block(self.part, self.rotated[:, self.space.sort[self.block]], self.space.budgets[self.block], one, two):
            for k in range(0, len(all_a), PAIRS_AT_ONCE):
                a, b = all_a[k : k + PAIRS_AT_ONCE], all_b[k : k + PAIRS_AT_ONCE]
                mine = self.space.first_block(self.space.squares(self.rotated[a] - self.rotated[b])) == self.block
                a, b = a[mine], b[mine]
                good = (self.vectors[a] * self.vectors[b]).sum(axis=1) / (self.norm[a] * self.norm[b]) >= self.cosine
                yield a[good], b[good]

    def take(self, one: np.ndarray, two: np.ndarray | None = None, count: bool = True) -> None:
        """Join the trees of linked rows; with ``count``, count the links and keep the edges."""
        for a, b in self.links(one, two):
            if count:
                np.add.at(self.counts, a, self.copies[b])
                np.add.at(self.counts, b, self.copies[a])
            while len(a := a[apart := self.root[a] != self.root[b]]):
                b = b[apart]
                # Each root hooks to one smaller root; the rest is tried again.
                x, y = np.minimum(self.root[a], self.root[b]), np.maximum(self.root[a], self.root[b])
                y, first = np.unique(y, return_index=True)
                if count:
                    self.edges.append(np.stack([self.ids[x[first]], self.ids[y]]))
                self.root[y] = x[first]
                while (self.root[self.root] != self.root).any():
                    self.root = self.root[self.root]


def task_links(links: _Links, home: np.ndarray, part: np.ndarray, i: int, j: int) -> None:
    """All links of a task: homes meet homes and visitors, of the same part or of two."""
    if i == j:
        homes = np.flatnonzero(home)
        links.take(homes)
        links.take(homes, np.flatnonzero(~home))
        return
    mine, theirs = part == i, part == j
    for own in (mine, theirs):  # their edges come from the parts' own tasks
        links.take(np.flatnonzero(home & own), count=False)
    links.take(np.flatnonzero(home & mine), np.flatnonzero(theirs))
    links.take(np.flatnonzero(~home & mine), np.flatnonzero(home & theirs))


_KEYS = ("label", "dim", "block", "cell", "i", "j")


def _verify(cosine: float, grids: dict[int, Grid]):
    spaces: dict[int, Subspaces] = {}

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        key = [table.column(c).to_numpy() for c in _KEYS]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        starts = np.concatenate([[0], change, [table.num_rows]])
        ids, copies, home, own = (table.column(c).to_numpy() for c in ("id", "copies", "home", "part"))
        vectors = table.column("vector").combine_chunks()
        out: dict[str, list] = {"a": [], "b": [], "n": []}
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if e - s < 2 or not home[s:e].any():
                continue
            dim = int(key[1][s])
            if dim not in spaces:
                spaces[dim] = Subspaces(dim, cosine, grids[dim])
            links = _Links(spaces[dim], int(key[2][s]), cosine, _matrix(vectors.slice(s, e - s)), ids[s:e], copies[s:e])
            task_links(links, home[s:e], own[s:e], int(key[4][s]), int(key[5][s]))
            for edge in links.edges:
                out["a"] += edge[0].tolist()
                out["b"] += edge[1].tolist()
                out["n"] += [0] * edge.shape[1]
            hit = np.flatnonzero(links.counts)
            out["a"] += links.ids[hit].tolist()
            out["b"] += [None] * len(hit)
            out["n"] += links.counts[hit].tolist()
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in _KEYS]
            other = np.any([k != k[-1] for k in key], axis=0)
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if cut:
                held.append(batch.slice(0, cut))
            if held and (cut or any(held[-1].column(c)[-1].as_py() != k[0] for c, k in zip(_KEYS, key))):
                yield flush(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield flush(held)

    return run


def link_counts(classes: DataFrame, cosine: float = 0.98, chunk: int = 4096, grid: Grid | None = None) -> DataFrame:
    """``classes(id, label, vector, copies)``, distinct vectors -> ``(a, b, n)``.

    Rows with ``b`` are links of a forest; those without say that ``a`` has
    ``n`` links more (copies counted).
    """
    # One row for each length of vectors: lengths are few.
    sizes = classes.groupBy(F.size("vector").alias("dim"), "label").count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    grids = {r["dim"]: grid or choose_grid(r["dim"], cosine, r["n"]) for r in sizes}
    # Cells hold ids; the vectors join the tasks last, so they are moved once.
    placed = classes.select("id", "label", "vector").mapInArrow(_place(cosine, grids), "id long, label long, dim long, block long, cell long, home boolean")
    cells = ["label", "dim", "block", "cell"]
    placed = materialise(placed, "cells")
    crowd = placed.groupBy(*cells).agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("all"))
    crowd = crowd.where("homes > 0 and all > 1").select(*cells, F.ceil(F.col("all") / chunk).cast("int").alias("parts"))
    rows = placed.join(crowd, cells).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j")))
    tasks = rows.select("id", *cells, "home", "part", F.inline(pairs))
    tasks = tasks.join(classes.select("id", "vector", "copies"), "id")
    dealt = tasks.repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    return dealt.mapInArrow(_verify(cosine, grids), "a long, b long, n long")


def _label_codes(classes: DataFrame) -> DataFrame:
    """``classes`` with their labels, of any type, as whole numbers in ``code``."""
    if classes.schema["label"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return classes.withColumn("code", F.col("label").cast("long"))
    codes = materialise(classes.select("label").distinct().withColumn("code", F.monotonically_increasing_id()), "labels")
    return classes.join(codes, "label")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row.

    Rows are compared when their labels are equal and not null and their
    vectors have the same length.  A vector that is null or zero, or holds a
    null or a non-finite number, links with nothing.  Repeated rows are vectors
    of their own that link with each other.  A null id never is a component's
    smallest unless all are null; ``kept`` is true where the id is the
    component's.  Other columns are not carried.  An empty table gives an empty
    one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>").alias("vector"))
    number = "x is not null and not isnan(x) and abs(x) < double('infinity')"
    usable = F.expr(f"coalesce(label is not null and size(vector) > 0 and forall(vector, x -> {number}) and exists(vector, x -> x <> 0), false)")
    rows = rows.withColumn("key", F.when(usable, F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("vector").cast("array<string>")), 256)))
    rows = materialise(rows, "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"))
    # The ids are those of one write, read ever after.
    classes = _label_codes(materialise(classes.withColumn("class", F.monotonically_increasing_id()), "classes"))
    found = materialise(link_counts(classes.select(F.col("class").alias("id"), F.col("code").alias("label"), "vector", "copies"), cosine, **options), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("class"), "root")
    member = classes.drop("vector", "label", "code").join(counts, "class", "left").join(roots, "class", "left")
    member = materialise(member.select("key", "least", F.coalesce("root", "class").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "members")
    smallest = member.groupBy("root").agg(F.min("least").alias("component"))
    named = member.join(smallest, "root").select("key", "n_links", "component")
    linked = rows.where("key is not null").select("vec_id", "key").join(named, "key").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
