"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a seeded order, form blocks.  With weight w a source's
block k (from 0) is released at slot floor(k / w) and due at slot
ceil((k + 1) / w).  Each slot takes the released block that is due first.  As
the weights sum to one, every block meets its deadline, and after any number of
slots each source is less than one block from its share.

Weights are integer parts of a period.  The schedule repeats after a period, so
one period's table places any number of blocks.  When a source runs out, the
rest go on with their weights renormalised (the next phase): all documents are
placed, and the deviation holds within each phase.  A phase that ends before
its period does is simulated to its end only.

The driver plans ``MAX_SOURCES`` sources at most.  Of more, the largest half of
that number are planned so, with pools that share out the others by hash; a
task plans the sources of a pool over the pool's blocks in the same way.  Such a
source is less than a block from its share of its pool's blocks, and the pool
from its own share of all.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .shared import materialise

#: Sources that one plan schedules at most; see above for more of them.
MAX_SOURCES = 1000
#: Stretches are broadcast up to this number; more are joined block by block.
BROADCAST_STRETCHES = 20_000


def edf_order(parts: list[int], slots: int | None = None, left: list[int] | None = None) -> np.ndarray:
    """The source of each slot, for ``slots`` slots (a period of ``sum(parts)`` by default).

    With ``left`` blocks of each source, the order ends with the first source that runs out.
    """
    n, period = len(parts), sum(parts)
    taken = [0] * n
    order: list[int] = []
    ready = [-(-period // p) * n + s for s, p in enumerate(parts)]  # deadline * n + source
    heapq.heapify(ready)
    later: dict[int, list[int]] = {}
    push, pop = heapq.heappush, heapq.heappop
    for now in range(period if slots is None else slots):
        for due in later.pop(now, ()):
            push(ready, due)
        s = pop(ready) % n
        order.append(s)
        taken[s] = k = taken[s] + 1
        if left is not None and k == left[s]:
            break
        part = parts[s]
        due = -(-(k + 1) * period // part) * n + s
        release = k * period // part
        if release <= now + 1:
            push(ready, due)
        else:
            later.setdefault(release, []).append(due)
    return np.array(order, dtype=np.int64)


def edf_slots(parts: list[int]) -> list[list[int]]:
    """For each source the slots, in a period of ``sum(parts)``, that its blocks take."""
    order = edf_order(parts)
    return [np.flatnonzero(order == s).tolist() for s in range(len(parts))]


def smoothed_parts(sizes: list[int], power: float = 0.5, period: int = 1000) -> list[int]:
    """Parts in proportion to sizes to a power; at least one each, largest remainders first."""
    if not sizes:
        return []
    shares = [n**power for n in sizes]
    total = sum(shares)
    exact = [period * s / total for s in shares]
    parts = [max(1, int(e)) for e in exact]
    for i in sorted(range(len(sizes)), key=lambda i: (int(exact[i]) - exact[i], i))[: max(0, period - sum(parts))]:
        parts[i] += 1
    return parts


@dataclass(frozen=True)
class Stretch:
    """A source's blocks within a phase: block ``first_block + k`` takes the slot
    ``first_slot + k // len(slots) * length + slots[k % len(slots)]``."""

    phase: int
    source: int
    first_block: int
    n_blocks: int
    first_slot: int
    length: int
    slots: np.ndarray
    period: int
    part: int


def phases(blocks: list[int], parts: list[int]) -> list[Stretch]:
    """The schedule of ``blocks[s]`` blocks of each source: what each phase takes."""
    left = list(blocks)
    active = [s for s in range(len(blocks)) if blocks[s]]
    out: list[Stretch] = []
    start = phase = 0
    while active:
        weights = [parts[s] for s in active]
        period = sum(weights)
        rest = [left[s] for s in active]
        # Some source has run out by its last block's deadline.
        latest = min(-(-n * period // w) for n, w in zip(rest, weights))
        order = edf_order(weights, min(period, latest), rest)
        grouped = np.split(np.argsort(order, kind="stable"), np.cumsum(np.bincount(order, minlength=len(active)))[:-1])
        if any(len(t) == n for t, n in zip(grouped, rest)):
            length = end = len(order)
        else:
            length, end = period, min((n - 1) // w * period + int(t[(n - 1) % w]) + 1 for n, w, t in zip(rest, weights, grouped))
        for s, w, t in zip(active, weights, grouped):
            taken = end // length * len(t) + int(np.searchsorted(t, end % length))
            if taken:
                out.append(Stretch(phase, s, blocks[s] - left[s], taken, start, length, t, period, w))
            left[s] -= taken
        active = [s for s in active if left[s]]
        start, phase = start + end, phase + 1
    return out


_STRETCH = "__key string, __phase int, __first long, __n long, __start long, __length long, __slots array<long>, __period long, __part long"


def _stretch_rows(keys: list[str], plan: list[Stretch]) -> list[tuple]:
    return [(keys[p.source], p.phase, p.first_block, p.n_blocks, p.first_slot, p.length, p.slots.tolist(), p.period, p.part) for p in plan]


def _placed(rows: DataFrame, key: str, block: str, stretches: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the slot of their block and the stretch's columns."""
    stretches = stretches.withColumnRenamed("__key", "__of")
    if few:  # counted by the driver
        within = (F.col(block) >= F.col("__first")) & (F.col(block) < F.col("__first") + F.col("__n"))
        joined = rows.join(F.broadcast(stretches), (F.col(key) == F.col("__of")) & within)
    else:
        each = stretches.withColumn("__block", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1)))
        joined = rows.join(each, (F.col(key) == F.col("__of")) & (F.col(block) == F.col("__block"))).drop("__block")
    k = F.col(block) - F.col("__first")
    size = F.size("__slots")
    slot = F.col("__start") + F.floor(k / size) * F.col("__length") + F.element_at("__slots", (k % size + 1).cast("int"))
    return joined.drop("__of").withColumn("__slot", slot.cast("long"))


def _window(block: str) -> dict[str, Column]:
    k, start = F.col(block) - F.col("__first"), F.col("__start")
    return {
        "mix_phase": F.col("__phase"),
        "mix_slot": F.col("__slot"),
        "mix_release": (start + F.floor(k * F.col("__period") / F.col("__part"))).cast("long"),
        "mix_deadline": (start + F.ceil((k + 1) * F.col("__period") / F.col("__part"))).cast("long"),
    }


_OWN = "__key __rank __of __block __slot __turn __pool __phase __first __n __start __length __slots __period __part __g __d __r __i __before".split()
_PLANNED = ["__phase", "__first", "__n", "__start", "__length", "__slots", "__period", "__part", "__slot"]


def _schedule(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """``rows(__key, mix_block, ...)`` with their windows, by ``sizes(__key, n, part)`` in blocks."""
    spark = rows.sparkSession
    largest = [tuple(r) for r in sizes.orderBy(F.col("n").desc(), "__key").limit(most + 1).select("__key", "n", "part").collect()]
    if len(largest) <= most:
        nodes, pooled = sorted(largest), None
    else:
        alone, n_pools = largest[: most // 2], most - most // 2
        others = sizes.join(F.broadcast(spark.createDataFrame([(k,) for k, _, _ in alone], "__key string")), "__key", "left_anti")
        pool = F.concat(F.lit("pool "), F.pmod(F.xxhash64("__key"), F.lit(n_pools)).cast("string"))
        pooled = materialise(others.withColumn("__pool", pool), "pools")
        pools = [tuple(r) for r in pooled.groupBy("__pool").agg(F.sum("n"), F.sum("part")).collect()]
        nodes = sorted(alone) + sorted(pools)

    plan = phases([n for _, n, _ in nodes], [p for _, _, p in nodes])
    names = [k for k, _, _ in nodes]
    n_alone = len(nodes) if pooled is None else len(alone)
    table = spark.createDataFrame(_stretch_rows(names, [p for p in plan if p.source < n_alone]), _STRETCH)
    few = len(plan) <= BROADCAST_STRETCHES
    placed = _placed(rows, "__key", "mix_block", table, few).withColumns(_window("mix_block")).drop(*_PLANNED)
    if pooled is None:
        return placed

    def share_out(group: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(zip(group["__key"], group["n"], group["part"]))
        found = _stretch_rows([k for k, _, _ in keys], phases([int(n) for _, n, _ in keys], [int(p) for _, _, p in keys]))
        return pd.DataFrame(found, columns=[c.split()[0] for c in _STRETCH.split(", ")])

    inner = materialise(pooled.groupBy("__pool").applyInPandas(share_out, _STRETCH).join(pooled.select("__key", "__pool"), "__key"), "stretches")
    rest = rows.join(pooled.select("__key", "__pool"), "__key")
    rest = _placed(rest, "__key", "mix_block", inner.drop("__pool"), False).drop(*_PLANNED[:-1]).withColumnRenamed("__slot", "__turn")
    outer = spark.createDataFrame(_stretch_rows(names, [p for p in plan if p.source >= n_alone]), _STRETCH)
    rest = _placed(rest, "__pool", "__turn", outer, few).withColumns(_window("__turn")).drop(*_PLANNED, "__pool", "__turn")
    return placed.unionByName(rest)


def mix(
    docs: DataFrame, weights: dict[str | None, int] | None = None, block_rows: int = 32, id_col: str = "doc_id", source: str = "source", power: float = 0.5, period: int = 1000, max_sources: int = MAX_SOURCES
) -> DataFrame:
    """``docs`` with ``mix_block, mix_slot, mix_release, mix_deadline, mix_phase, mix_position``.

    ``weights`` are the target parts by source, integers (others get one part);
    without them the parts follow the sources' sizes to ``power``.
    ``mix_position`` orders all rows: slot by slot, in a block by the seeded
    order (the digest of the id; rows of equal id by their other columns'
    hash).  A null source is a source; a null id has the empty digest.  No row
    is dropped or repeated, however many sources there are; an empty table
    gives an empty one.  Columns named as new ones are replaced; those named as
    the plan's own (``_OWN``) are not carried.
    """
    new = ["mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_phase", "mix_position"]
    docs = docs.drop(*new, *_OWN)
    names = docs.columns
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    sizes = materialise(docs.groupBy(key.alias("__key")).agg(F.count(F.lit(1)).alias("rows")), "sources")
    if weights is not None:
        if any(p < 1 for p in weights.values()):
            raise ValueError("weights must be positive integers")
        listed = docs.sparkSession.createDataFrame([("" if k is None else f"={k}", int(p)) for k, p in weights.items()], "__key string, part long")
        sizes = sizes.join(F.broadcast(listed), "__key", "left").withColumn("part", F.coalesce("part", F.lit(1).cast("long")))
    else:
        head = [tuple(r) for r in sizes.limit(max_sources + 1).collect()]
        if len(head) <= max_sources:
            head.sort()
            parts = smoothed_parts([n for _, n in head], power, period)
            sizes = docs.sparkSession.createDataFrame([(k, n, p) for (k, n), p in zip(head, parts)], "__key string, rows long, part long")
        else:
            total = sizes.agg(F.sum(F.pow("rows", F.lit(power)))).first()[0]
            sizes = sizes.withColumn("part", F.greatest(F.lit(1), F.floor(period * F.pow("rows", F.lit(power)) / total)).cast("long"))
    sizes = sizes.select("__key", F.ceil(F.col("rows") / block_rows).cast("long").alias("n"), "part")
    rows = ranked(docs, F.col(source), F.md5(F.col(id_col).cast("string")), [F.xxhash64(*names)], "__rank")
    rows = rows.withColumns({"__key": key, "mix_block": F.floor((F.col("__rank") - 1) / block_rows).cast("long")})
    placed = _schedule(rows, sizes, max_sources)
    position = F.col("mix_slot") * block_rows + (F.col("__rank") - 1) % block_rows
    return placed.withColumn("mix_position", position.cast("long")).select(*names, *new)


def in_mixed_order(docs: DataFrame, keep_position: bool = False, **options) -> DataFrame:
    """``docs``, whole, dealt to partitions and sorted by the mix's positions.

    Written as files, their names' order and the rows' order are the mix's.
    Files are read again in another order: ``keep_position`` adds ``mix_position``.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = mix(docs, **options).repartitionByRange(n, "mix_position").sortWithinPartitions("mix_position")
    return rows.select(*[c for c in docs.columns if c != "mix_position" or not keep_position], *["mix_position"] * keep_position)
