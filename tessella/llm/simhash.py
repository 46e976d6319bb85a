"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the
vector of the segments' popcounts.  A popcount is kept in unary (1 as 01, 2 as
11), so the Manhattan distance of two embeddings is the number of bits in which
their codes differ.  It is a lower bound of the fingerprints' Hamming distance:
fingerprints within ``max_bits`` have embeddings within ``max_bits``.  The
segments form ``max_bits + 3`` groups; a Manhattan distance of ``max_bits``
touches that many groups at most, so at least three groups agree.  The grid's
cells are the embedding's coordinates on three groups (every choice of three):
each linked pair meets in a cell.  Within a cell, embeddings are range-joined
under the Manhattan distance, and what is within ``max_bits`` is verified by
the Hamming distance.

Cells hold *distinct* fingerprints.  A cell with more than ``chunk`` of them is
cut into parts by hash and each pair of parts becomes a task of its own, so no
task holds an unbounded cell.  A task returns a spanning forest of the links
that it found, never all pairs: the trees within each part once, and between
two parts one edge for each two trees that it joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialise, slices

_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    flat = b" ".join(words)
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[i:j], 42) for i, j in zip(starts, stops)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):  # whole texts, in bounded memory
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = int((np.uint64(1) << _SHIFTS)[2 * ones > len(hashes)].sum(dtype=np.uint64))
    return value - (1 << 64) if value >> 63 else value


def with_fingerprints(docs: DataFrame, column: str = "simhash", text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` and its texts' fingerprints in ``column`` (replaced if it exists)."""
    docs = docs.drop(column)
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            out = pa.array([fingerprint(t, width) for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*names, column])

    return docs.mapInArrow(run, docs.withColumn(column, F.lit(0).cast("long")).schema)


def _group_masks(max_bits: int) -> list[int]:
    """The bits of each choice of three of the ``max_bits + 3`` segment groups."""
    segments = np.array_split(np.arange(32), max_bits + 3)
    masks = [sum(3 << (2 * int(s)) for s in g) for g in segments]
    full = [sum(m) for m in combinations(masks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in full]


_LOW = 0x5555555555555555


def _cells(prints: DataFrame, max_bits: int) -> DataFrame:
    """``prints(fp)`` -> a row for each fingerprint and choice of groups."""
    coded = prints.select("fp", F.expr(f"shiftleft(shiftrightunsigned(fp, 1) & fp & {_LOW}L, 1) | ((shiftrightunsigned(fp, 1) | fp) & {_LOW}L)").alias("code"))
    choices = [F.struct(F.lit(i).alias("grid"), F.col("code").bitwiseAND(F.lit(m).cast("long")).alias("cell")) for i, m in enumerate(_group_masks(max_bits))]
    return coded.select("fp", F.inline(F.array(*choices)))


def embedding(prints: np.ndarray) -> np.ndarray:
    """The segments' popcounts of fingerprints, each in unary."""
    bits = prints.view(np.uint64)
    high, low = bits >> np.uint64(1) & np.uint64(_LOW), bits & np.uint64(_LOW)
    return (high & low) << np.uint64(1) | high | low


def _trees(prints: np.ndarray, max_bits: int) -> np.ndarray:
    """For each fingerprint the first one of its component."""
    codes, bits = embedding(prints), prints.view(np.uint64)  # a signed number's bits would be counted of its absolute value
    root = np.full(len(prints), -1)
    for start in range(len(prints)):
        if root[start] >= 0:
            continue
        root[start] = start
        front = np.array([start])
        while len(front):
            rest = np.flatnonzero(root < 0)
            found = np.zeros(len(rest), dtype=bool)
            for part in np.array_split(front, -(-len(front) // 512)):
                a, b = np.nonzero(np.bitwise_count(codes[part][:, None] ^ codes[rest][None, :]) <= max_bits)
                found[b[np.bitwise_count(bits[part[a]] ^ bits[rest[b]]) <= max_bits]] = True
            front = rest[found]
            root[front] = start
    return root


def _star(prints: np.ndarray, root: np.ndarray) -> np.ndarray:
    """An edge from the first node of each component to each of its others."""
    other = np.flatnonzero(root != np.arange(len(root)))
    return np.stack([prints[root[other]], prints[other]], axis=1)


def task_forest(prints: np.ndarray, part: np.ndarray, i: int, j: int, max_bits: int) -> np.ndarray:
    """The edges that the task of parts ``i`` and ``j`` of a cell returns."""
    root = _trees(prints, max_bits)
    if i == j:
        return _star(prints, root)
    out, heads = [], []
    for k in (i, j):
        own = np.flatnonzero(part == k)
        within = _trees(prints[own], max_bits)
        heads.append(own[np.unique(within)])
        if i == 0 and (k == j or j == 1):  # each part's own trees, by one task
            out.append(_star(prints[own], within))
    # One edge for each two trees of the parts that are one component here.
    tops = np.concatenate(heads)
    _, first = np.unique(root[tops], return_index=True)
    of = dict(zip(root[tops[first]].tolist(), tops[first].tolist()))
    rest = np.delete(tops, first)
    return np.concatenate([*out, np.stack([prints[[of[r] for r in root[rest].tolist()]], prints[rest]], axis=1) if len(rest) else np.empty((0, 2), np.int64)])


def _links_within_runs(rows: tuple[np.ndarray, ...], max_bits: int, few: int = 6) -> np.ndarray:
    """``rows``: fingerprints, their parts and sorted keys; whole runs of equal keys."""
    fp, own, *key = rows
    change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
    starts = np.concatenate([[0], change])
    lens = np.diff(np.concatenate([starts, [len(fp)]]))
    run = np.repeat(np.arange(len(starts)), lens)
    found = []
    short = ((lens > 1) & (lens <= few))[run]
    values, run = fp[short], run[short]
    codes, bits = embedding(values), values.view(np.uint64)
    for step in range(1, min(few, len(values))):
        at = np.flatnonzero(run[:-step] == run[step:])
        at = at[np.bitwise_count(codes[at] ^ codes[at + step]) <= max_bits]
        at = at[np.bitwise_count(bits[at] ^ bits[at + step]) <= max_bits]
        found.append(np.stack([values[at], values[at + step]], axis=1))
    for s, n in zip(starts[lens > few], lens[lens > few]):
        found.append(task_forest(fp[s : s + n], own[s : s + n], int(key[2][s]), int(key[3][s]), max_bits))
    return np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)


def _links_of_runs(max_bits: int):
    """Batches sorted by key -> links; a run may go on over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            links = _links_within_runs(tuple(map(np.concatenate, zip(*held))), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            other = np.any([k != k[-1] for k in rows[2:]], axis=0)
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if cut:
                held.append(tuple(r[:cut] for r in rows))
            if held and (cut or any(h[-1] != k[0] for h, k in zip(held[-1][2:], rows[2:]))):
                yield flush()
                held = []
            held.append(tuple(r[cut:] for r in rows))
        if held:
            yield flush()

    return run


def fingerprint_links(prints: DataFrame, max_bits: int = 3, chunk: int = 4096) -> DataFrame:
    """``prints(fp)``, distinct -> links ``(a, b)`` that connect what is within ``max_bits``."""
    cells = _cells(prints, max_bits)
    crowded = cells.groupBy("grid", "cell").count().where(F.col("count") > chunk)
    crowded = crowded.select("grid", "cell", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    tasks = cells.join(crowded, ["grid", "cell"], "left").select("fp", "grid", "cell", F.coalesce("parts", F.lit(1)).alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: (F.col("parts") == 1) | (k != part))
    pairs = F.transform(other, lambda k: F.struct(F.least(part, k).alias("i"), F.greatest(part, k).alias("j")))
    tasks = tasks.select("fp", part.alias("part"), "grid", "cell", F.inline(pairs))
    dealt = tasks.repartition("grid", "cell", "i", "j").sortWithinPartitions("grid", "cell", "i", "j")
    return dealt.mapInArrow(_links_of_runs(max_bits), "a long, b long")


def simhash_groups(docs: DataFrame, max_bits: int = 3, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, simhash, component_id)`` of every row of ``docs``.

    ``component_id`` is the smallest id reachable by links.  Null and wordless
    texts have fingerprint zero and link like others.  A null id takes part in
    links but is no component's smallest unless all are null (then null).
    Repeated rows give repeated rows; an empty table gives an empty one; other
    columns are not carried, so their names cannot clash.
    """
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    light = materialise(with_fingerprints(light, "fp", "text", width).select("doc_id", "fp"), "simhash")
    return group_fingerprints(light, max_bits).withColumnRenamed("fp", "simhash")


def group_fingerprints(light: DataFrame, max_bits: int = 3) -> DataFrame:
    """``light(doc_id, fp)`` -> ``(doc_id, fp, component_id)``; see :func:`simhash_groups`."""
    prints = materialise(light.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = connected_components(fingerprint_links(prints.select("fp"), max_bits))
    member = prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = materialise(member, "members")
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(smallest, "root").select("fp", "component_id")
    return light.join(named, "fp").select("doc_id", "fp", "component_id")
