"""Operator 13: whitening of vectors by their leading principal components.

Each task centres its vectors at their own mean and multiplies; the tasks' moments are written to the shared folder, a row
each, and merged by sums that put back the difference of their means. What the driver gets is a matrix in the size of the
dimension, however many vectors there are. Its leading eigenvectors are broadcast, and one more pass projects the vectors and
takes the moments of what comes out, which give the error of the whitening.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.common import materialise, tidied
from cohortmill.llm.eigen import leading_eigen

#: Scaled components beyond this are taken as this.
LIMIT = 1 << 53
#: Eigenvalues below this part of the largest count as none.
NONE = 1e-11
_LONG = (1 << 63) - 1


def whole(vectors: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """floor(scale * component) + shift."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64) + shift


class Moments:
    """Count, mean and centred products of the rows of matrices that are added one by one."""

    def __init__(self, d: int):
        self.n, self.mean, self.m2 = 0, np.zeros(d), np.zeros((d, d))

    def add(self, x: np.ndarray) -> None:
        n = len(x)
        mean = x.mean(0)
        y = x - mean
        mean += y.mean(0)  # what rounding left
        y = x - mean
        both, gap = self.n + n, mean - self.mean
        self.m2 += y.T @ y + np.outer(gap, gap) * (self.n * n / both)
        self.mean += gap * (n / both)
        self.n = both


def _by_length(batch: pa.RecordBatch, column: int):
    """(length, places of rows, matrix of float or double) for each length of vectors in a batch."""
    lists = batch.column(column)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    size, start = np.diff(ends), ends[:-1] - ends[0]
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        if d:
            yield int(d), at, flat[start[at][:, None] + np.arange(d)]


def merged(parts: DataFrame, means: dict[int, list[float]]) -> dict[int, np.ndarray]:
    """Of each length, the sum of centred products about the given means. `parts` has d, n, mean, m2 (by rows) of each task."""
    spark = parts.sparkSession
    at = spark.createDataFrame(sorted(means.items()), "d int, centre array<double>")
    x = parts.join(F.broadcast(at), "d").select("d", "n", F.zip_with("mean", "centre", lambda a, b: a - b).alias("gap"), F.posexplode("m2").alias("pos", "v"))
    wide = F.size("gap")
    value = F.col("v") + F.col("n") * F.get("gap", F.floor(F.col("pos") / wide).cast("int")) * F.get("gap", F.col("pos") % wide)
    out = {d: np.zeros(len(m) ** 2) for d, m in means.items()}
    for d, pos, v in x.groupBy("d", "pos").agg(F.sum(value).alias("v")).collect():
        out[d][pos] = v
    return {d: m.reshape(int(len(m) ** 0.5), -1) for d, m in out.items()}


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each complete and finite vector and each of its leading components.

    Vectors of each length are fitted and whitened by themselves. Null vectors and those that hold a null or non-finite entry
    are left out, empty ones have no components; a null id is an id as any other, a repeated row counts as often as it stands.
    Scaled entries beyond 2 ** 53 are taken as that, a deviation beyond a long as the greatest long. A component without
    variance has no whitened value, and none is explained where there is no variance at all (a single vector, or equal ones).
    Other columns are ignored; an empty table gives no rows.
    """
    spark, v = vectors.sparkSession, F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(fine).select(F.col(id_col).alias("vec_id"), v.alias("v"))
    id_kind = rows.schema["vec_id"].dataType

    def fit(batches):
        held: dict[int, tuple[Moments, list[int]]] = {}
        for batch in batches:
            for d, _, x in _by_length(batch, 0):
                x = whole(x, scale, shift)
                m, s = held.setdefault(d, (Moments(d), [0] * d))
                m.add(x.astype(np.float64))
                s[:] = [a + sum(map(int, c)) for a, c in zip(s, x.T)] if np.abs(x).max() > 1 << 40 else [a + int(b) for a, b in zip(s, x.sum(0))]
        for d, (m, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.n], pa.int64()), pa.array([m.mean.tolist()], pa.list_(pa.float64())), pa.array([m.m2.ravel().tolist()], pa.list_(pa.float64())), pa.array([list(map(Decimal, s))], pa.list_(pa.decimal128(38, 0)))], ["d", "n", "mean", "m2", "s"])

    parts = materialise(rows.select("v").mapInArrow(tidied(fit), "d int, n long, mean array<double>, m2 array<double>, s array<decimal(38,0)>"))
    n = {r["d"]: r["n"] for r in parts.groupBy("d").agg(F.sum("n").alias("n")).collect()}
    sums = {d: [0] * d for d in n}
    for d, pos, s in parts.select("d", F.posexplode("s").alias("pos", "s")).groupBy("d", "pos").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect():
        sums[d][pos] = int(s)
    model: dict[int, tuple] = {}
    for d, m in merged(parts, {d: [s / n[d] for s in sums[d]] for d in n}).items():
        values, axes = leading_eigen(m / n[d], components)
        trace = float(np.trace(m / n[d]))
        model[d] = (n[d], sums[d], values, axes, trace)
    known = spark.sparkContext.broadcast(model)

    def project(batches):
        held: dict[int, Moments] = {}
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.float64())]
        names = ["vec_id", "d", "deviation", "whitened", "n", "m2"]
        own = None
        for batch in batches:
            own = batch.schema.field(0).type
            for d, at, x in _by_length(batch, 1):
                count, s, values, axes, _ = known.value[d]
                x = whole(x, scale, shift)
                # n x - S in whole numbers, of any size where a long does not hold them
                if max(count * int(np.abs(x).max()), *map(abs, s)) < 1 << 62:
                    off = count * x - np.array(s, np.int64)
                else:
                    off = count * x.astype(object) - np.array(s, object)
                if int(np.abs(off).max()) ** 2 * d < _LONG:
                    deviation = (off.astype(np.int64) ** 2).sum(1)
                else:
                    deviation = [min(_LONG, int(t)) for t in (off.astype(object) ** 2).sum(1)]
                some = values > NONE * max(values[0], 0.0)
                w = np.full((len(x), len(values)), np.nan)
                w[:, some] = (off.astype(np.float64) / count) @ axes[some].T / np.sqrt(values[some])
                if some.any():
                    held.setdefault(d, Moments(int(some.sum()))).add(w[:, some])
                flat = pa.array(w.ravel(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), flat)
                none = [pa.nulls(len(x), t) for t in kinds[3:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([d] * len(x), kinds[0]), pa.array(deviation, kinds[1]), lists, *none], names)
        for d, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, own), pa.array([d], kinds[0]), pa.nulls(1, kinds[1]), pa.array([m.mean.tolist()], kinds[2]), pa.array([m.n], kinds[3]), pa.array([m.m2.ravel().tolist()], kinds[4])], names)

    # rows with m2 are the moments of a task, all others are vectors
    done = materialise(rows.mapInArrow(tidied(project), f"vec_id {id_kind.simpleString()}, d int, deviation long, whitened array<double>, n long, m2 array<double>"))
    tasks = done.where("m2 IS NOT NULL").select("d", "n", F.col("whitened").alias("mean"), "m2")
    mean: dict[int, list[float]] = {}
    for d, pos, s in tasks.select("d", F.posexplode(F.transform("mean", lambda x: x * F.col("n"))).alias("pos", "s")).groupBy("d", "pos").agg(F.sum("s").alias("s")).orderBy("d", "pos").collect():
        mean.setdefault(d, []).append(s / n[d])
    error = {d: float(np.abs(m / n[d] - np.eye(len(m))).max()) for d, m in merged(tasks, mean).items()}
    about = [(d, i, n[d], float(e) / trace if trace > 0 else None, error.get(d)) for d, (_, _, values, _, trace) in model.items() for i, e in enumerate(values)]
    about = spark.createDataFrame(about, "d int, at int, n long, explained double, identity_error double")
    each = done.where("m2 IS NULL").select("vec_id", "d", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    # a row for each length and component
    out = each.join(F.broadcast(about), ["d", "at"])
    return out.select(F.col("vec_id").alias(id_col), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.when(F.col("explained").isNotNull(), F.greatest("explained", F.lit(0.0))).alias("explained"), "identity_error")
