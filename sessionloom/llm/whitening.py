"""Whitening of embeddings: spectra by incremental eigendecomposition, refined over all vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.cluster import spread
from sessionloom.llm.centroids import SCALE, whole_vectors
from sessionloom.llm.spectra import EPS, Spectra
from sessionloom.llm.storage import batch_settings, store

STREAMS = 16  # spectra a task keeps side by side, so that one array operation serves them all
FAN_IN = 16  # spectra joined by one task
LOW = (1 << 32) - 1

STATE = (
    "part long, n long, high array<long>, low array<long>, mean array<double>, "
    "energies array<double>, basis array<double>"
)


@dataclass
class Model:
    """Count and exact sums of the distinct vectors, and their principal components: unit columns of
    ``vectors``, variances ``energies`` falling, the variance in all directions, and the largest
    entry of the whitened covariance minus the identity."""

    n: int
    sums: list[int]
    energies: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], float)

    @property
    def known(self) -> np.ndarray:
        """True for components whose variance is more than rounding; the others cannot be whitened."""
        return self.energies > len(self.sums) * EPS * self.trace


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists of an Arrow batch as rows of integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def partial_spectra(fit: DataFrame, size: int) -> DataFrame:
    """One state per task: count, sums in two halves that cannot overflow, mean and spectrum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spectra = Spectra(STREAMS, size)
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = matrix(batch.column("x")) if len(batch) else np.zeros((0, size), np.int64)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & LOW).sum(0)
            spectra.take(x.astype(float))
        if n:
            frame = state_frame(TaskContext.get().partitionId(), n, high, low, spectra.joined())
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return fit.mapInArrow(run, STATE)


def state_frame(part: int, n: int, high, low, spectrum: Spectra) -> pd.DataFrame:
    row = [part, n, high, low, spectrum.mean[0], spectrum.values[0], spectrum.basis[0].ravel()]
    return pd.DataFrame([row], columns=["part", "n", "high", "low", "mean", "energies", "basis"])


def join_states(states: pd.DataFrame) -> pd.DataFrame:
    """States of a group as one, by rank-one updates with their eigenpairs and means."""
    states = states.sort_values("part")
    size = len(states["mean"].iloc[0])
    spectra = Spectra(0, size)
    spectra.count = states["n"].to_numpy(float)
    spectra.mean = np.stack(states["mean"].to_list()).astype(float)
    spectra.values = np.stack(states["energies"].to_list()).astype(float)
    spectra.basis = np.stack(states["basis"].to_list()).astype(float).reshape(-1, size, size)
    # Sums keep to their halves; what overflows the low one moves up.
    low = sum(np.asarray(x, object) for x in states["low"])
    high = sum(np.asarray(x, object) for x in states["high"]) + (low >> 32)
    part = int(states["part"].iloc[0]) // FAN_IN
    return state_frame(part, int(states["n"].sum()), high.tolist(), (low & LOW).tolist(), spectra.joined())


def whole_spectrum(fit: DataFrame, size: int) -> tuple[int, list[int], np.ndarray] | None:
    """(count, exact sums, eigenvectors as columns) of all vectors; None without vectors.

    States meet in a tree of FAN_IN, so no task and no collect holds more than that many.
    """
    states = store(partial_spectra(fit, size), "spectra")
    while (count := states.count()) > 1:
        group = F.floor(F.col("part") / FAN_IN).alias("group")
        if count <= FAN_IN:
            group = F.lit(0).alias("group")
        states = store(states.groupBy(group).applyInPandas(join_states, STATE), "spectra")
    row = states.first()
    if row is None:
        return None
    sums = [h * (LOW + 1) + l for h, l in zip(row["high"], row["low"])]
    return row["n"], sums, np.array(row["basis"], float).reshape(size, size)


def projected_covariance(fit: DataFrame, mean: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Covariance of the centred vectors in the directions ``basis``, summed over tasks."""
    width = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                y = (matrix(batch.column("x")) - mean) @ basis
                total += y.T @ y
        yield pa.RecordBatch.from_pydict(
            {"cell": pa.array(np.arange(width * width)), "value": pa.array(total.ravel())}
        )

    cells = fit.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(width * width)
    for row in cells.collect():  # width squared numbers, whatever the number of vectors
        out[row["cell"]] = row["value"]
    return out.reshape(width, width) / n


def fit_whitening(fit: DataFrame, size: int, components: int) -> Model | None:
    """Components of distinct integer vectors ``x``.

    Tasks keep spectra by centred rank-one updates, which meet by rank-one updates; the directions
    found are then refined by Rayleigh-Ritz over all vectors: the covariance in that basis, nearly
    diagonal, is summed in one more pass and its eigenvectors turn the basis. Signs make the largest
    entry positive. The identity error is measured on the whitened vectors in a last pass.
    """
    found = whole_spectrum(fit, size)
    if found is None or not size:
        return None
    n, sums, basis = found
    mean = np.array([s / n for s in sums], float)
    ritz = projected_covariance(fit, mean, basis, n)
    energies, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    vectors = (basis @ turn)[:, ::-1][:, :components]
    top = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    vectors /= np.sqrt((vectors * vectors).sum(0))
    model = Model(n, sums, np.maximum(energies[::-1][:components], 0.0), vectors, float(np.trace(ritz)))
    known = model.known
    if known.any():
        scaled = vectors[:, known] / np.sqrt(model.energies[known])
        off = projected_covariance(fit, mean, scaled, n) - np.eye(int(known.sum()))
        model.identity_error = float(np.abs(off).max())
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n x - S) squared, exact; null where it does not fit a long."""
    reach = n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(map(abs, sums))
    if len(sums) * reach * reach < 1 << 63:
        off = x * n - np.array(sums, np.int64)
        return pa.array((off * off).sum(1))
    off = x.astype(object) * n - np.array(sums, object)
    return pa.array([v if v < 1 << 63 else None for v in (off * off).sum(1).tolist()], pa.int64())


def whiten(
    vectors: DataFrame, components: int = 4, scale: int = SCALE, size: int | None = None,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: one row per vector
    and component, numbered from 1 by falling variance.

    Vectors that are null or hold null, NaN or infinite entries take no part, nor do those of another
    length than ``size`` (default: the most frequent length, the longer of equally frequent ones).
    Entries become integers floor(scale * entry), held at the ends of the long range. The fit takes
    each distinct vector once; repeated rows, null or repeated ids all have their rows in the result.
    With fewer dimensions than ``components`` there are fewer rows. A component without variance has
    no whitened value (null) and explains 0, or null where all vectors are equal. An empty table has
    no rows. Of equal variances any basis is taken, the same for all rows.
    """
    batch_settings(vectors.sparkSession)
    rows = store(whole_vectors(vectors, key, vector, size, scale), "vectors")
    if size is None:
        lengths = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
        row = lengths.orderBy(F.desc("n"), F.desc("size")).first()
        size = row["size"] if row else 0
        rows = rows.where(F.size("x") == size)
    fit = spread(store(rows.select("x").distinct(), "fit"))
    model = fit_whitening(fit, size, components)
    return whitened_rows(rows, model)


def whitened_rows(rows: DataFrame, model: Model | None) -> DataFrame:
    """All rows in the components of a model; no rows without a model."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None:
            return
        width, known, mean = len(model.energies), model.known, model.mean
        divisor = np.sqrt(np.where(known, model.energies, 1.0))
        share = model.energies / model.trace if model.trace > 0 else np.full(width, np.nan)
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("x"))
            white = ((x - mean) @ model.vectors) / divisor
            take = pa.array(np.repeat(np.arange(len(x)), width))
            many = len(take)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id").take(take),
                    "component": pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(many, model.n, np.int64)),
                    "deviation": deviations(x, model.n, model.sums).take(take),
                    "whitened": pa.array(white.ravel(), mask=np.tile(~known, len(x))),
                    "explained": pa.array(np.tile(share, len(x)), from_pandas=True),
                    "identity_error": pa.array([model.identity_error] * many, pa.float64()),
                }
            )

    return rows.mapInArrow(run, schema)
