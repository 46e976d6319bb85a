"""Quality scores by a kernel ridge model with isotonic calibration.

Document statistics are standardised and mapped by random Fourier features,
whose products approximate a Gaussian kernel.  Each partition sums its part of
the normal equations; the sums, of a fixed size, are solved on the driver.
Labelled documents of two of three folds are learnt from: one fits the ridge
scores, the other their isotonic calibration (pool adjacent violators over
scores in bins of a fixed number).  The third fold is never learnt from.

All statistics are of whole texts and all labelled rows of the folds are used;
the model's size does not depend on their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b"#*$%&<>",
    b"|",
    b"!",
    b".",
    b",;:",
    b"?\"'()-",
    b"_/\\=+@{}[]~^`",
    b" \t\r\x0b\x0c",
    b"\n",
    bytes(range(128, 256)),
)
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c), _i] = 1.0
N_STATS = len(_CLASSES) + 9


def statistics(text: str | None) -> list[float]:
    """The document statistics of a whole text (null: empty)."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    shares = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS_OF) / n
    words = raw.split()
    n_words = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    return [
        *np.sqrt(shares).tolist(),
        float(np.log1p(len(raw))),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths <= 3).mean()),
        len(set(words)) / n_words**0.8,
        sum(map(eq, words, words[1:])) / n_words,
        len(set(lines)) / n_lines,
        float(np.log1p(n_words / n_lines)),
        sum(x.rstrip()[-1:] in b".!?\"" for x in lines) / n_lines,
    ]


@dataclass
class Model:
    """A fitted model; ``weights`` None gives 0.5 (there was nothing to learn)."""

    mean: np.ndarray
    scale: np.ndarray
    n_features: int
    width: float
    seed: int
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        directions = rng.standard_normal((x.shape[1], self.n_features)) / self.width
        phases = rng.uniform(0, 2 * np.pi, self.n_features)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / self.n_features) * np.cos(z @ directions + phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        return np.clip(np.interp(raw, *self.knots) if self.knots else raw, 0.0, 1.0)


def pool_adjacent_violators(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to ``y`` in weighted squares."""
    blocks: list[list[float]] = []
    for value, w in zip(y, weight):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, u, k = blocks.pop()
            v0, u0, k0 = blocks[-1]
            blocks[-1] = [(v0 * u0 + v * u) / (u0 + u), u0 + u, k0 + k]
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks]) if blocks else np.empty(0)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, x)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_STATS)


def _sums(rows: DataFrame, of) -> dict[tuple[int, int], float]:
    """Partition sums of matrices ``of(x, y)``, added up: one small table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "v": total[i, j]})

    found = rows.select("x", "y").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r.i, r.j): r.v for r in found.collect()}  # as many rows as the matrix has cells


def _dense(cells: dict[tuple[int, int], float], shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for at, v in cells.items():
        out[at] = v
    return out


def fit(fit_rows: DataFrame, calibration_rows: DataFrame, n_features: int = 128, width: float = 6.0, ridge: float = 0.01, bins: int = 2048, seed: int = 4) -> Model:
    """Learn from rows ``(x, y)``; ``y`` is 0 or 1."""
    moments = _dense(_sums(fit_rows, lambda x, y: np.vstack([np.append(x.sum(0), len(x)), np.append((x * x).sum(0), y.sum())])), (2, N_STATS + 1))
    n, positive = moments[0, -1], moments[1, -1]
    mean = moments[0, :-1] / max(1, n)
    scale = np.sqrt(np.maximum(moments[1, :-1] / max(1, n) - mean**2, 0)) + 1e-3
    model = Model(mean, scale, n_features, width, seed)
    if not 0 < positive < n:
        return model
    shares = positive / n

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = model.features(x)
        w = np.where(y > 0, 0.5 / shares, 0.5 / (1 - shares))[:, None]
        return np.hstack([(f * w).T @ f, (f * w).T @ y[:, None]])

    size = n_features + 1
    system = _dense(_sums(fit_rows, equations), (size, size + 1))
    penalty = ridge * np.diag(np.append(np.ones(n_features), 0.0))
    weights = np.linalg.solve(system[:, :size] / n + penalty / n_features, system[:, size] / n)
    model.weights = weights

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip((model.raw(x) + 0.5) / 2 * bins, 0, bins - 1).astype(int)
        return np.vstack([np.bincount(at, minlength=bins), np.bincount(at, weights=y, minlength=bins)])

    counts = _dense(_sums(calibration_rows, histogram), (2, bins))
    filled = np.flatnonzero(counts[0])
    if len(filled):
        level = pool_adjacent_violators(counts[1, filled] / counts[0, filled], counts[0, filled])
        centre = (filled + 0.5) / bins * 2 - 0.5
        first = np.flatnonzero(np.diff(level, prepend=-1.0))
        last = np.append(first[1:] - 1, len(level) - 1)
        middle = (centre[first] + centre[last]) / 2
        # Below and above the outermost blocks the score goes on towards 0 and 1.
        model.knots = np.concatenate([[-4.0], middle, [5.0]]), np.concatenate([[min(0.0, level[0])], level[first], [1.0]])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    The fold of a row is crc32(doc_id as text) mod 3: 0 fits, 2 calibrates, 1
    is held out.  Null labels and labels without document teach nothing; a
    label given twice counts twice.  Null texts are scored as empty; a null id
    is not held out and has no label.  Without labels of both kinds every score
    is 0.5.  Other columns are not carried; an empty table gives an empty one.
    """
    stats = materialise(with_statistics(docs, id_col, text), "statistics")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    rows = materialise(stats.join(known.where(fold != 1), "doc_id").withColumn("fold", fold).select("fold", "x", "y"), "labelled")
    model = fit(rows.where("fold = 0"), rows.where("fold = 2"), **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = stats.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "x")
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
