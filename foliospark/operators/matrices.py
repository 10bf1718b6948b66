"""Matrices of points (one row per point: id, vec) and clustering.

Sizes: points may be any number; the length of `vec` (dimensions) and the
number of clusters are small, so d x d and k x d arrays may reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliospark.functions import vectors as V
from foliospark.functions.stage import checkpointed


def entries(points: DataFrame) -> DataFrame:
    """i, j, v: coordinate form; j from 0."""
    return points.select(F.col("id").alias("i"), F.posexplode("vec").alias("j", "v"))


def transposed(coo: DataFrame) -> DataFrame:
    return coo.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def times_vector(points: DataFrame, x: list[float]) -> DataFrame:
    """id, y of each row times a vector."""
    return points.select("id", V.dot(F.col("vec"), F.array(*map(F.lit, x))).alias("y"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, v of a matrix product in coordinate form: one equi-join on the inner index, then sums with partial aggregation."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("va")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("vb"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def row_scaled(points: DataFrame, factor: Column) -> DataFrame:
    return points.withColumn("vec", F.transform("vec", lambda x: x * factor))


def column_scaled(points: DataFrame, factors: list[float]) -> DataFrame:
    return points.withColumn("vec", F.zip_with("vec", F.array(*map(F.lit, factors)), lambda x, y: x * y))


def normalized_rows(points: DataFrame) -> DataFrame:
    return points.withColumn("vec", V.normalized(F.col("vec")))


def column_norms(points: DataFrame) -> DataFrame:
    """j, norm of each column."""
    return entries(points).groupBy("j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def diagonal(points: DataFrame) -> DataFrame:
    """id, v of the entries whose column equals the row's id."""
    return points.select("id", F.get("vec", F.col("id").cast("int")).alias("v")).where("v IS NOT NULL")


def bilinear(points: DataFrame, row: float, column: float) -> DataFrame:
    """v between four neighbouring entries of rows numbered by id."""
    r = int(row // 1)
    near = points.where(F.col("id").isin(r, r + 1)).select("id", V.interpolated(F.col("vec"), column).alias("x"))
    low, high = F.max(F.when(F.col("id") == r, F.col("x"))), F.max(F.when(F.col("id") == r + 1, F.col("x")))
    return near.agg((low + (F.coalesce(high, low) - low) * (row - r)).alias("v"))


def gram(points: DataFrame) -> np.ndarray:
    """The d x d matrix of inner products of columns; partial sums per Arrow batch, d x d rows to the driver."""
    import pyarrow as pa

    def part(batches):
        total = None
        for b in batches:
            col = b.column("vec")
            if len(col):
                m = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    rows = points.select("vec").mapInArrow(part, "i INT, j INT, v DOUBLE").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = max((r.i for r in rows), default=-1) + 1
    out = np.zeros((d, d))
    for r in rows:
        out[r.i, r.j] = r.v
    return out


def singular_values(points: DataFrame, k: int) -> list[float]:
    """The k largest singular values, from the eigenvalues of the Gram matrix."""
    return [float(np.sqrt(max(0.0, x))) for x in np.linalg.eigvalsh(gram(points))[::-1][:k]]


def principal_direction(points: DataFrame) -> list[float]:
    """The right singular vector of the largest singular value; its largest entry is positive."""
    _, v = np.linalg.eigh(gram(points))
    v = v[:, -1]
    return (v * (1 if v[np.abs(v).argmax()] >= 0 else -1)).tolist()


def solved(a: np.ndarray, b: np.ndarray, damping: float = 0.0) -> np.ndarray:
    """x of a symmetric positive definite system with a damped diagonal; d x d on the driver."""
    return np.linalg.solve(a + damping * np.eye(len(a)), b)


def orthonormal(a: np.ndarray) -> np.ndarray:
    """Columns made orthonormal one after the other (signs as in the columns)."""
    q, r = np.linalg.qr(a)
    return q * np.sign(np.where(np.diag(r) == 0, 1, np.diag(r)))


def nearest_centre(vec: Column, centres: list[list[float]]) -> Column:
    """The number of the nearest centre; of equally near ones the first."""
    gaps = F.array(*(V.squared_distance(vec, F.array(*map(F.lit, c))) for c in centres))
    return F.array_position(gaps, F.array_min(gaps)).cast("int") - 1


def kmeans(points: DataFrame, k: int, most: int = 50) -> DataFrame:
    """id, cluster by Lloyd's rounds until no assignment changes (at most `most`).

    Start: the k smallest ids are clusters of their own, all others belong to
    the first. Clusters are numbered by size, largest first. A round is one
    pass with a partial aggregation; k centres reach the driver.
    """
    first = {r.id: i for i, r in enumerate(points.select("id").orderBy("id").limit(k).collect())}
    start = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in first.items() for x in p)), F.col("id")), F.lit(0))
    now = checkpointed(points.select("id", "vec", start.alias("cluster")))
    for _ in range(most):
        sums = now.select("cluster", F.posexplode("vec").alias("j", "v")).groupBy("cluster", "j").agg(F.avg("v").alias("v"))
        means = {r.cluster: list(r.c) for r in sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("c")).collect()}
        order = sorted(means)
        best = nearest_centre(F.col("vec"), [means[c] for c in order])
        moved = checkpointed(now.select("id", "vec", F.element_at(F.array(*map(F.lit, order)), best + 1).alias("cluster"), F.col("cluster").alias("old")))
        changed = not moved.where("cluster <> old").isEmpty()
        now = moved.drop("old")
        if not changed:
            break
    sizes = now.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").collect()
    rank = F.create_map(*(F.lit(x) for i, r in enumerate(sizes) for x in (r.cluster, i)))
    return now.select("id", F.element_at(rank, F.col("cluster")).alias("cluster"))


def principal_splits(points: DataFrame, most: int) -> DataFrame:
    """id, cluster: the largest cluster is cut by the sign along its principal direction, until no cluster has more than `most` points or cannot be cut.

    Each cut works on the covariance matrix (d x d) of one cluster; points stay distributed.
    """
    now = checkpointed(points.select("id", "vec", F.lit(0).alias("cluster")))
    done: set[int] = set()
    number = 0
    while True:
        stats = now.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > most).orderBy(F.desc("n"), "cluster").collect()
        target = next((r.cluster for r in stats if r.cluster not in done), None)
        if target is None:
            return now.select("id", "cluster")
        own = now.where(F.col("cluster") == target)
        mean = [r.v for r in own.select(F.posexplode("vec").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("v")).orderBy("j").collect()]
        centre = F.array(*map(F.lit, mean))
        direction = principal_direction(own.select("id", F.zip_with("vec", centre, lambda x, y: x - y).alias("vec")))
        side = V.dot(F.zip_with("vec", centre, lambda x, y: x - y), F.array(*map(F.lit, direction))) > 0
        number += 1
        cut = checkpointed(now.withColumn("cluster", F.when((F.col("cluster") == target) & side, F.lit(number)).otherwise(F.col("cluster"))))
        if cut.where(F.col("cluster") == number).isEmpty() or cut.where(F.col("cluster") == target).isEmpty():
            done.add(target)
            number -= 1
            continue
        now = cut


def agglomerated(points: np.ndarray, limit: float) -> list[int]:
    """Cluster numbers of a small matrix of points (cubic time, driver): the nearest centroids are joined until exp(entropy of sizes) is at most `limit`; clusters are numbered by size."""
    groups = [[i] for i in range(len(points))]
    while len(groups) > 1:
        share = np.array([len(g) for g in groups]) / len(points)
        if np.exp(-(share * np.log(share)).sum()) <= limit:
            break
        centres = np.array([points[g].mean(axis=0) for g in groups])
        gaps = ((centres[:, None] - centres[None]) ** 2).sum(axis=2)
        gaps[np.tril_indices(len(groups))] = np.inf
        a, b = np.unravel_index(gaps.argmin(), gaps.shape)
        groups[a] += groups.pop(b)
    out = [0] * len(points)
    for n, g in enumerate(sorted(groups, key=lambda g: (-len(g), min(g)))):
        for i in g:
            out[i] = n
    return out


def labelled_centroids(points: DataFrame) -> tuple[list[int], np.ndarray]:
    """Labels and mean vectors of labelled points: as many as there are labels."""
    rows = points.select("label", F.posexplode("vec").alias("j", "v")).groupBy("label", "j").agg(F.avg("v").alias("v")).orderBy("label", "j").collect()
    labels = sorted({r.label for r in rows})
    return labels, np.array([[r.v for r in rows if r.label == x] for x in labels])


def as_frame(spark: SparkSession, names: str, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, names)
