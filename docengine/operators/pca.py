"""Principal components of vectors: one distributed pass for the moments, a small eigenproblem on the driver.

The moments of d-dimensional vectors are d (d + 3) / 2 sums, whatever the number of vectors. Tasks' sums are merged in a
tree of FAN branches, so the driver gets FAN rows at most, whatever the number of tasks, and solves a d x d problem.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.arrays import normalised

DIMS = (8, 16, 32, 48, 64)
FAN = 16


@dataclass
class Summary:
    module: str
    source: str
    n_embeddings: int
    full_dim: int
    elbow_kneedle: int
    elbow_kneedle_snapped: int
    elbow_second_difference: int
    elbow_95pct: int
    cumulative_at: dict[int, float]
    ratios: list[float] = field(default_factory=list)
    eigenvalues: list[float] = field(default_factory=list)
    cumulative: list[float] = field(default_factory=list)


@dataclass
class Model:
    mean: np.ndarray
    components: np.ndarray  # rows

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(self.mean.tolist(), self.components.tolist())], "mean array<double>, components array<array<double>>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> "Model":
        row = spark.read.parquet(path).first()
        return Model(np.array(row["mean"]), np.array(row["components"]))


def union(parts: list[DataFrame], column: str = "embedding", least: int = 100) -> DataFrame:
    """Vectors of several tables as one, repeats kept; fewer than `least` are an error."""
    from functools import reduce

    whole = reduce(DataFrame.unionAll, [p.select(column) for p in parts])
    if (n := whole.count()) < least:
        raise ValueError(f"{least} vectors or more are needed, got {n}")
    return whole


def moments(vectors: DataFrame, column: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """How many vectors, their mean, and their scatter around it, from partial sums of each task around its own mean."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, scatter = 0, None, None
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch[column].to_numpy()).astype(np.float64)
            m = x.mean(0)
            s = (x - m).T @ (x - m)
            if mean is None:
                n, mean, scatter = len(x), m, s
            else:
                n, mean, scatter = _merged((n, mean, scatter), (len(x), m, s))
        if n:
            yield _row(0, n, mean, scatter)

    kind = "part long, n long, mean binary, scatter binary"
    tasks = vectors._jdf.rdd().getNumPartitions()
    parts = vectors.select(column).where(F.col(column).isNotNull()).mapInPandas(run, kind).withColumn("part", F.spark_partition_id().cast("long"))

    def together(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for row in group.itertuples():
            total = _part(row) if total is None else _merged(total, _part(row))
        return _row(int(group["part"].iloc[0]), *total)

    while tasks > FAN:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInPandas(together, kind)
        tasks = -(-tasks // FAN)
    rows = sorted(parts.collect(), key=lambda r: (r.part, bytes(r["mean"])))  # FAN rows at most
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    total = _part(rows[0])
    for row in rows[1:]:
        total = _merged(total, _part(row))
    return total


def _row(part: int, n: int, mean: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"part": [part], "n": [n], "mean": [mean.tobytes()], "scatter": [scatter.tobytes()]})


def _part(row) -> tuple[int, np.ndarray, np.ndarray]:
    mean = np.frombuffer(row.mean)
    return int(row.n), mean, np.frombuffer(row.scatter).reshape(len(mean), -1)


def _merged(a, b):
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + np.outer(d, d) * a[0] * b[0] / n


def kneedle(y: np.ndarray, sensitivity: float = 1.0) -> int | None:
    """The knee of a rising concave curve over 1, 2, ...: the first local maximum of its distance above the diagonal, both
    scaled to [0, 1], after which the distance falls by the sensitivity times the mean step."""
    n = len(y)
    if n < 2 or y[-1] == y[0]:
        return None
    x = np.arange(n) / (n - 1)
    difference = (y - y.min()) / (y.max() - y.min()) - x
    level = None
    knee = None
    for i in range(1, n - 1):
        if difference[i] >= difference[i - 1] and difference[i] >= difference[i + 1]:
            knee, level = i + 1, difference[i] - sensitivity * np.abs(np.diff(x)).mean()
        elif difference[i] <= difference[i - 1] and difference[i] <= difference[i + 1]:
            level = 0.0 if knee is not None else None
        if knee is not None and level is not None and difference[i + 1] < level:
            return knee
    return None


def snapped(dim: int, dims: tuple[int, ...] = DIMS) -> int:
    """The nearest allowed width, the smaller one of two."""
    return min(dims, key=lambda d: (abs(d - dim), d))


def fit(vectors: DataFrame, module: str = "", source: str = "", column: str = "embedding", dims: tuple[int, ...] = DIMS, keep: int = 1024) -> tuple[Model, Summary]:
    """Components, eigenvalues and elbows; fewer than two vectors are an error."""
    n, mean, scatter = moments(vectors, column)
    if n < 2:
        raise ValueError(f"two vectors or more are needed, got {n}")
    values, rows = np.linalg.eigh(scatter / (n - 1))
    count = min(len(mean), n - 1)
    values, rows = np.maximum(values[::-1][:count], 0), rows[:, ::-1].T[:count]
    signs = np.sign(rows[np.arange(count), np.abs(rows).argmax(1)])
    ratios = values / max(np.trace(scatter) / (n - 1), 1e-300)
    cumulative = np.cumsum(ratios)
    second = int(np.argmin(np.diff(values, 2))) + 2 if count >= 3 else 1
    knee = kneedle(cumulative) or int(np.argmax(cumulative >= 0.9)) + 1
    at = {d: float(cumulative[min(d, count) - 1]) for d in dims}
    whole = Summary(module, source, n, len(mean), knee, snapped(knee, dims), second, int(np.searchsorted(cumulative, 0.95)) + 1, at, ratios[:keep].tolist(), values[:keep].tolist(), cumulative[:keep].tolist())
    return Model(mean, rows * signs[:, None]), whole


def project(vectors: DataFrame, model: Model, n: int, column: str = "embedding", into: str = "projected") -> DataFrame:
    """The first n coordinates around the mean, scaled to unit length; expressions only."""
    centred = F.zip_with(column, F.array(*map(F.lit, model.mean.tolist())), lambda x, m: x.cast("double") - m)
    rows = F.array(*(F.array(*map(F.lit, row)) for row in model.components[:n].tolist()))
    product = lambda c: F.transform(rows, lambda r: F.aggregate(F.zip_with(r, c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    return vectors.withColumn("__c", centred).withColumn(into, normalised(product(F.col("__c")))).drop("__c")


def second_difference_elbow(values: DataFrame, index: str = "i", value: str = "eigenvalue") -> DataFrame:
    """elbow: where the second difference of an ordered spectrum is smallest; 1 for fewer than three values."""
    from pyspark.sql import Window as W

    w = W.orderBy(index)  # one row for each component
    second = F.lead(value, 2).over(w) - 2 * F.lead(value, 1).over(w) + F.col(value)
    return values.withColumn("d", second).agg(F.coalesce(F.min_by(F.col(index) + 1, F.when(F.col("d").isNotNull(), F.col("d"))), F.lit(1)).cast("int").alias("elbow"))


def verdict(first: Column, second: Column) -> Column:
    """Does the first module's vectors need fewer dimensions than the second's."""
    return F.when(first < second, "confirmed").when(first > second, "rejected").otherwise("inconclusive")


def as_row(spark, whole: Summary) -> DataFrame:
    return spark.createDataFrame([{k: ({str(a): b for a, b in v.items()} if isinstance(v, dict) else v) for k, v in asdict(whole).items()}])
