"""Queries of matrix and clustering operators on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import matrices as M
from foliospark.plans.registry import query
from foliospark.sources.tables import table

_V = "list_transform(embedding, lambda x: x::DOUBLE)"


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def _r(c, n=5):
    return F.round(c, n) + F.lit(0.0)


@query("matvec", f"SELECT vec_id AS id, round(list_sum(list_transform({_V}, lambda x, i: x * i)), 5) + 0.0 AS y FROM embeddings")
def matvec(spark, d):
    p = _points(spark, d)
    n = len(p.select("vec").head().vec)
    return M.times_vector(p, [float(i) for i in range(1, n + 1)]).select("id", _r(F.col("y")).alias("y"))


@query("transpose", f"SELECT unnest(range(0, len(embedding)))::INT AS i, vec_id AS j, round(unnest({_V}), 6) + 0.0 AS v FROM embeddings")
def transpose(spark, d):
    return M.transposed(M.entries(_points(spark, d))).select("i", "j", _r(F.col("v"), 6).alias("v"))


@query("matmul", f"WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS j, unnest({_V}) AS v FROM embeddings) SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 4) + 0.0 AS v FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2")
def matmul(spark, d):
    """Columns times columns: the transpose times the matrix."""
    coo = M.entries(_points(spark, d))
    return M.product(M.transposed(coo), coo).select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), _r(F.col("v"), 4).alias("v"))


@query("matrix_scale", f"SELECT vec_id AS id, list_transform({_V}, lambda x: round(x * 2 * label, 5) + 0.0) AS vec FROM embeddings")
def matrix_scale(spark, d):
    p = _points(spark, d)
    n = len(p.select("vec").head().vec)
    s = M.column_scaled(M.row_scaled(p, F.col("label")), [2.0] * n)
    return s.select("id", F.transform("vec", lambda x: _r(x)).alias("vec"))


@query("matrix_normalize", f"SELECT vec_id AS id, list_transform({_V}, lambda x: round(x / sqrt(list_dot_product({_V}, {_V})), 5) + 0.0) AS vec FROM embeddings")
def matrix_normalize(spark, d):
    return M.normalized_rows(_points(spark, d)).select("id", F.transform("vec", lambda x: _r(x)).alias("vec"))


@query("column_norms", f"SELECT j, round(sqrt(sum(v * v)), 5) AS norm FROM (SELECT unnest(range(0, len(embedding)))::INT AS j, unnest({_V}) AS v FROM embeddings) GROUP BY 1")
def column_norms(spark, d):
    return M.column_norms(_points(spark, d)).select("j", _r(F.col("norm")).alias("norm"))


@query("matrix_diagonal", f"SELECT vec_id AS id, round({_V}[vec_id + 1], 6) + 0.0 AS v FROM embeddings WHERE vec_id < len(embedding)")
def matrix_diagonal(spark, d):
    return M.diagonal(_points(spark, d)).select("id", _r(F.col("v"), 6).alias("v"))


@query("bilinear", f"WITH x AS (SELECT vec_id, {_V}[3] + ({_V}[4] - {_V}[3]) * 0.5 AS x FROM embeddings WHERE vec_id IN (4, 5)) SELECT round((SELECT x FROM x WHERE vec_id = 4) + ((SELECT x FROM x WHERE vec_id = 5) - (SELECT x FROM x WHERE vec_id = 4)) * 0.25, 6) + 0.0 AS v")
def bilinear(spark, d):
    return M.bilinear(_points(spark, d), 4.25, 2.5).select(_r(F.col("v"), 6).alias("v"))


@query("outer_product", "SELECT a.n_nationkey AS i, b.n_nationkey AS j, a.n_regionkey * b.n_regionkey AS v FROM nation a, nation b")
def outer_product(spark, d):
    """Of a fixed table of 25 rows with itself, as a product over an inner index of one."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    a = n.select(F.col("n_nationkey").alias("i"), F.lit(0).alias("j"), F.col("n_regionkey").alias("v"))
    return M.product(a, M.transposed(a)).select("i", "j", F.col("v").cast("bigint").alias("v"))


@query("svd")
def svd(spark, d):
    return M.as_frame(spark, "k INT, value DOUBLE", [(i, round(v, 4)) for i, v in enumerate(M.singular_values(_points(spark, d), 5))])


@query("kmeans")
def kmeans(spark, d):
    return M.kmeans(_points(spark, d), 5)


@query("pddp")
def pddp(spark, d):
    p = _points(spark, d)
    return M.principal_splits(p, max(1, p.count() // 4))


@query("agglomerative")
def agglomerative(spark, d):
    """The mean vectors of the labels (one per label) joined to at most four states."""
    labels, centres = M.labelled_centroids(_points(spark, d))
    return M.as_frame(spark, "label INT, cluster INT", list(zip(labels, M.agglomerated(centres, 4.0))))


@query("solve_spd")
def solve_spd(spark, d):
    """j, x of the damped normal equations for the label as a linear function of the vector."""
    p = _points(spark, d)
    n = len(p.select("vec").head().vec)
    right = {r.j: r.v for r in M.entries(p).join(p.select(F.col("id").alias("i"), "label"), "i").groupBy("j").agg(F.sum(F.col("v") * F.col("label")).alias("v")).collect()}
    x = M.solved(M.gram(p), [right.get(j, 0.0) for j in range(n)], 1.0)
    return M.as_frame(spark, "j INT, x DOUBLE", [(j, round(float(v), 6)) for j, v in enumerate(x)])


@query("orthonormal")
def orthonormal(spark, d):
    """i, j, v: orthonormal columns that span the columns of the Gram matrix."""
    q = M.orthonormal(M.gram(_points(spark, d)))
    return M.as_frame(spark, "i INT, j INT, v DOUBLE", [(i, j, round(float(v), 6)) for i, row in enumerate(q) for j, v in enumerate(row)])
