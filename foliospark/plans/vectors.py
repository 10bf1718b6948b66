"""Queries of the array functions with their SQL twins, on the embeddings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from foliospark.functions import vectors as V
from foliospark.functions.stage import written
from foliospark.plans.registry import columns, query
from foliospark.sources.tables import table


def A():
    return F.col("a")


def B():
    return F.col("b")


_BASE = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_reverse(list_transform(embedding, lambda x: x::DOUBLE)) AS b, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS w FROM embeddings)"


def _base(df):
    a = F.col("embedding").cast("array<double>")
    return df.select("vec_id", "label", a.alias("a"), F.reverse(a).alias("b"), F.transform(a, lambda x: F.abs(x)).alias("w"))


def _r(c, places=6):
    return F.round(c, places) + F.lit(0.0)


def vec(name, cols):
    columns(name, "embeddings", ["vec_id"], cols, base=_base, base_sql=_BASE)


def _rounded(c):
    return F.transform(c, lambda x: _r(x))


def _list(c):
    return f"list_transform({c}, lambda q: round(q, 6) + 0.0)"


_SUM, _SQ, _NORM = "list_sum(a)", "list_dot_product(a, a)", "sqrt(list_dot_product(a, a))"
vec("vec_sums", {"s": (lambda: _r(V.total(A())), f"round({_SUM}, 6) + 0.0"), "m": (lambda: _r(V.mean(A())), "round(list_avg(a), 6) + 0.0"), "var": (lambda: _r(V.variance(A())), "round(list_var_pop(a), 6) + 0.0"), "sd": (lambda: _r(F.sqrt(V.variance(A()))), "round(list_stddev_pop(a), 6) + 0.0")})
vec("vec_norm", {"sq": (lambda: _r(V.squares(A())), f"round({_SQ}, 6)"), "n": (lambda: _r(V.norm(A())), f"round({_NORM}, 6)"), "unit": (lambda: _rounded(V.normalized(A())), _list(f"list_transform(a, lambda x: x / {_NORM})")), "share": (lambda: _rounded(V.normalized_sum(F.col("w"))), _list("list_transform(w, lambda x: x / list_sum(w))"))})
vec("vec_weighted", {"ws": (lambda: _r(V.weighted_sum(A(), F.col("w"))), "round(list_dot_product(a, w), 6) + 0.0"), "wsq": (lambda: _r(V.weighted_squares(A(), F.col("w"))), "round(list_sum(list_transform(list_zip(a, w), lambda p: p[1] * p[1] * p[2])), 6) + 0.0")})
vec("vec_extremes", {"lo": (lambda: _r(F.array_min(A())), "round(list_min(a), 6) + 0.0"), "hi": (lambda: _r(F.array_max(A())), "round(list_max(a), 6) + 0.0"), "at_lo": (lambda: V.position_of_min(A()), "list_position(a, list_min(a)) - 1"), "at_hi": (lambda: V.position_of_max(A()), "list_position(a, list_max(a)) - 1")})
vec("vec_cosine", {"c": (lambda: _r(V.cosine(A(), B())), "round(list_cosine_similarity(a, b), 6) + 0.0"), "d": (lambda: _r(V.dot(A(), B())), "round(list_dot_product(a, b), 6) + 0.0"), "p": (lambda: _r(V.direct_product(A(), B(), 0.5)), f"round(sqrt({_NORM} * {_NORM}) * list_cosine_similarity(a, b), 6) + 0.0")})
vec("vec_euclid", {"d": (lambda: _r(V.distance(A(), B())), "round(list_distance(a, b), 6)"), "sq": (lambda: _r(V.squared_distance(A(), B())), "round(list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)"), "rms": (lambda: _r(V.root_mean_square(A(), B())), "round(list_distance(a, b) / sqrt(len(a)), 6)")})
vec("vec_shift", {"s": (lambda: _r(V.shifted_dot(A(), B(), 3)), "round(list_dot_product(list_slice(a, 4, len(a)), list_slice(b, 1, len(b) - 3)), 6) + 0.0")})
vec("convolve", {"c": (lambda: _rounded(V.convolve(F.slice("a", 1, 5), F.slice("b", 1, 3))), _list("list_transform(range(0, 7), lambda k: list_sum(list_transform(range(greatest(0, k - 2), least(k, 4) + 1), lambda i: a[i + 1] * b[k - i + 1])))"))})
vec("vec_orthogonal", {"ma": (lambda: _rounded(V.multiply_add(A(), B(), 0.5)), _list("list_transform(list_zip(a, b), lambda p: p[1] + 0.5 * p[2])")), "o": (lambda: _rounded(V.orthogonal(A(), B())), _list("list_transform(list_zip(a, b), lambda p: p[1] - list_dot_product(a, b) / list_dot_product(b, b) * p[2])"))})
vec("vec_entropy", {"e": (lambda: _r(V.entropy(F.col("w"))), "round(-list_sum(list_transform(list_filter(w, lambda x: x > 0), lambda x: x / list_sum(w) * ln(x / list_sum(w)))), 6)"), "n": (lambda: _r(V.states(F.col("w"))), "round(exp(-list_sum(list_transform(list_filter(w, lambda x: x > 0), lambda x: x / list_sum(w) * ln(x / list_sum(w))))), 6)")})
vec("vec_running", {"r": (lambda: _rounded(V.running(A())), _list("list_transform(range(1, len(a) + 1), lambda i: list_sum(list_slice(a, 1, i)))"))})
vec("interpolate", {"v": (lambda: _r(V.interpolated(A(), 2.25)), "round(a[3] + (a[4] - a[3]) * 0.25, 6) + 0.0"), "low": (lambda: _r(V.interpolated(A(), -3.0)), "round(a[1], 6) + 0.0"), "idx": (lambda: _r(V.real_index(F.array_sort(A()), 0.01)), "round(CASE WHEN len(list_filter(a, lambda x: x <= 0.01)) = 0 THEN 0 WHEN len(list_filter(a, lambda x: x <= 0.01)) = len(a) THEN len(a) - 1 ELSE len(list_filter(a, lambda x: x <= 0.01)) - 1 + (0.01 - list_sort(a)[len(list_filter(a, lambda x: x <= 0.01))]) / (list_sort(a)[len(list_filter(a, lambda x: x <= 0.01)) + 1] - list_sort(a)[len(list_filter(a, lambda x: x <= 0.01))]) END, 6) + 0.0")})
vec("sort_permutation", {"p": (lambda: V.sort_permutation(A()), "list_transform(list_sort(list_transform(range(1, len(a) + 1), lambda i: {'x': a[i], 'i': i})), lambda s: s.i - 1)"), "inv": (lambda: V.inverse_permutation(V.sort_permutation(A())), "list_transform(range(0, len(a)), lambda j: list_position(list_transform(list_sort(list_transform(range(1, len(a) + 1), lambda i: {'x': a[i], 'i': i})), lambda s: s.i - 1), j) - 1)"), "d": (lambda: _rounded(F.sort_array(A(), asc=False)), _list("list_reverse_sort(a)"))})
vec("vec_select", {"g": (lambda: _rounded(V.gather(A(), F.array(F.lit(3), F.lit(0), F.lit(3)))), _list("[a[4], a[1], a[4]]")), "closest": (lambda: V.closest(A(), 0.0), "list_position(list_transform(a, lambda x: abs(x)), list_min(list_transform(a, lambda x: abs(x)))) - 1"), "at": (lambda: V.position_of(A(), F.get(A(), F.lit(4))), "list_position(a, a[5]) - 1"), "n": (lambda: V.count_of(F.transform(A(), lambda x: F.floor(x)), F.lit(0).cast("bigint")), "len(list_filter(a, lambda x: floor(x) = 0))"), "nz": (lambda: V.nonzero(A()), "len(list_filter(a, lambda x: x <> 0))"), "has": (lambda: F.array_contains(A(), F.get(A(), F.lit(1))), "list_contains(a, a[2])")})
vec("vec_cut", {"removed": (lambda: _rounded(F.array_remove(A(), F.get(A(), F.lit(2)))), _list("list_filter(a, lambda x: x <> a[3])")), "dec": (lambda: _rounded(V.decimate(A(), 4)), _list("list_filter(a, lambda x, i: (i - 1) % 4 = 0)")), "rev": (lambda: _rounded(F.reverse(A())), _list("list_reverse(a)")), "first": (lambda: _rounded(F.slice("a", 1, 3)), _list("a[1:3]")), "last": (lambda: _rounded(F.slice("a", -3, 3)), _list("a[-3:]")), "glued": (lambda: F.size(F.concat(A(), B())).cast("bigint"), "len(a || b)")})
vec("vec_elementwise", {"sum": (lambda: _rounded(F.zip_with(A(), B(), lambda x, y: x + y)), _list("list_transform(list_zip(a, b), lambda p: p[1] + p[2])")), "prod": (lambda: _rounded(F.zip_with(A(), B(), lambda x, y: x * y)), _list("list_transform(list_zip(a, b), lambda p: p[1] * p[2])")), "scaled": (lambda: _rounded(F.transform(A(), lambda x: x * 2 - 1)), _list("list_transform(a, lambda x: x * 2 - 1)")), "roots": (lambda: _rounded(F.transform("w", lambda x: F.sqrt(x))), _list("list_transform(w, lambda x: sqrt(x))")), "exps": (lambda: _rounded(F.transform(A(), lambda x: F.exp(x))), _list("list_transform(a, lambda x: exp(x))")), "sign": (lambda: V.sign(A()), "list_transform(a, lambda x: CASE WHEN x < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)"), "clamped": (lambda: _rounded(V.clamp(A(), -0.05, 0.05)), _list("list_transform(a, lambda x: least(greatest(x, -0.05), 0.05))")), "up": (lambda: F.transform(A(), lambda x: F.ceil(x).cast("bigint")), "list_transform(a, lambda x: ceil(x)::BIGINT)")})
vec("vec_shape", {"inc": (lambda: V.starts_increasing(A()), "a[2] > a[1]"), "signed": (lambda: F.exists(A(), lambda x: x < 0), "list_min(a) < 0"), "iota": (lambda: F.transform(A(), lambda x, i: i.cast("bigint")), "range(0, len(a))"), "lin": (lambda: _rounded(V.linspace(0.0, 1.0, 5)), "[0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]"), "ints": (lambda: F.transform(A(), lambda x: (x * 1000).cast("bigint")), "list_transform(a, lambda x: trunc(x * 1000)::BIGINT)")})

columns("width_bucket", "lineitem", ["l_orderkey", "l_linenumber"], {
    "b": (lambda: V.bin_of(F.col("l_quantity"), 1.0, 50.0, 7), "CASE WHEN l_quantity >= 1 AND l_quantity < 50 THEN floor((l_quantity - 1) / 7.0)::BIGINT ELSE -1 END"),
    "edge": (lambda: V.clamped_bin(F.col("l_quantity"), 1.0, 50.0, 7), "CASE WHEN l_quantity >= 1 AND l_quantity <= 50 THEN least(floor((l_quantity - 1) / 7.0), 6)::BIGINT ELSE -1 END"),
})


@query("histogram", "SELECT least(floor((l_quantity - 1) / 7.0), 6)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1")
def histogram(spark, d):
    b = V.clamped_bin(F.col("l_quantity"), 1.0, 50.0, 7)
    return table(spark, d, "lineitem").groupBy(b.alias("bin")).agg(F.count("*").alias("n")).where("bin >= 0")


# ---------------------------------------------------------- arrays as rows: one series per customer, supplier or user

_SERIES = "(SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, o_totalprice AS x FROM orders)"


def _series(spark, d):
    w = Window.partitionBy("k").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("x"))
    return o.select("k", (F.row_number().over(w) - 1).cast("bigint").alias("i"), "x")


@query("running_sum", f"SELECT k, i, round(sum(x) OVER (PARTITION BY k ORDER BY i), 2) AS s FROM {_SERIES}")
def running_sum(spark, d):
    return _series(spark, d).select("k", "i", F.round(F.sum("x").over(Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)), 2).alias("s"))


@query("moving_avg_trailing", f"SELECT k, i, round(avg(x) OVER (PARTITION BY k ORDER BY i ROWS 3 PRECEDING), 4) AS m FROM {_SERIES}")
def moving_avg_trailing(spark, d):
    """Equal weights over the values so far, at most four, renormalised at the start."""
    return _series(spark, d).select("k", "i", F.round(F.avg("x").over(Window.partitionBy("k").orderBy("i").rowsBetween(-3, 0)), 4).alias("m"))


@query(
    "moving_avg_centred",
    f"WITH s AS (SELECT *, least(2, i, count(*) OVER (PARTITION BY k) - 1 - i) AS h FROM {_SERIES}) SELECT a.k, a.i, round(avg(b.x), 4) AS m FROM s a JOIN s b ON a.k = b.k AND b.i BETWEEN a.i - a.h AND a.i + a.h GROUP BY 1, 2",
)
def moving_avg_centred(spark, d):
    """A window of five that shrinks on both sides alike at the ends; one window of fixed size per row."""
    s = _series(spark, d)
    w = Window.partitionBy("k").orderBy("i")
    near = F.collect_list("x").over(w.rowsBetween(-2, 2))
    h = F.least(F.lit(2), F.col("i"), F.count("*").over(Window.partitionBy("k")) - 1 - F.col("i"))
    held = s.withColumn("near", near).withColumn("h", h.cast("int"))
    part = F.slice("near", F.least(F.lit(2), F.col("i")).cast("int") - F.col("h") + 1, 2 * F.col("h") + 1)
    return held.select("k", "i", F.round(V.mean(part), 4).alias("m"))


@query("local_extrema", f"WITH s AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS n FROM {_SERIES} WINDOW w AS (PARTITION BY k ORDER BY i)) SELECT k, i, CASE WHEN x > p AND x >= n THEN 'max' ELSE 'min' END AS kind FROM s WHERE x > p AND x >= n OR x < p AND x <= n")
def local_extrema(spark, d):
    w = Window.partitionBy("k").orderBy("i")
    s = _series(spark, d).withColumn("p", F.lag("x").over(w)).withColumn("n", F.lead("x").over(w))
    return s.where("x > p AND x >= n OR x < p AND x <= n").select("k", "i", F.when(F.expr("x > p AND x >= n"), "max").otherwise("min").alias("kind"))


_RUNS = "SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events"


@query("run_lengths", f"SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM ({_RUNS}) GROUP BY user_id, event_type, island")
def run_lengths(spark, d):
    """Values and lengths of runs of equal neighbours (gaps and islands)."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    all_, same = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    island = F.row_number().over(all_) - F.row_number().over(same)
    return e.withColumn("island", island).groupBy("user_id", "event_type", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).drop("island")


@query("adjacent_distinct", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def adjacent_distinct(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("p", F.lag("event_type").over(w))
    return e.where("NOT (p <=> event_type)").select("user_id", "event_id", "event_type")


@query("csr_offsets", "SELECT o_custkey AS k, sum(count(*)) OVER (ORDER BY o_custkey) - count(*) AS start_at FROM orders GROUP BY o_custkey")
def csr_offsets(spark, d):
    """Where each key's list starts when lists lie one after the other: offsets of range partitions plus running sums inside."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    part = written(n.repartitionByRange("k").withColumn("part", F.spark_partition_id()), "ranges")
    sums = part.groupBy("part").agg(F.sum("n").alias("in_part"))
    before = sums.select("part", F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return part.withColumn("inner", inside).join(F.broadcast(before), "part").select("k", (F.col("inner") + F.col("offset")).cast("bigint").alias("start_at"))


_SPLIT = f"""WITH s AS (SELECT k, i, x, sum(x) OVER w AS s1, sum(x * x) OVER w AS q1, count(*) OVER w AS n1, sum(x) OVER (PARTITION BY k) AS s, sum(x * x) OVER (PARTITION BY k) AS q, count(*) OVER (PARTITION BY k) AS n
 FROM (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS i, o_totalprice AS x FROM orders) WINDOW w AS (PARTITION BY k ORDER BY i)),
 e AS (SELECT k, i, (q1 - s1 * s1 / n1) + ((q - q1) - (s - s1) * (s - s1) / (n - n1)) AS sse FROM s WHERE n1 < n)
 SELECT k, min_by(i, round(sse, 0) * 1000 + i) AS split_at FROM e GROUP BY k"""


@query("optimal_split", _SPLIT)
def optimal_split(spark, d):
    """The last position of the left half of the sorted series at which two halves have the least squared error."""
    w = Window.partitionBy("k").orderBy("o_totalprice", "o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
    s = o.select("k", (F.row_number().over(w) - 1).cast("bigint").alias("i"), F.col("o_totalprice").alias("x"))
    up, whole = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("k")
    for name, c in (("s", F.col("x")), ("q", F.col("x") * F.col("x")), ("n", F.lit(1))):
        s = s.withColumn(f"{name}1", F.sum(c).over(up)).withColumn(name, F.sum(c).over(whole))
    e = s.where("n1 < n").withColumn("sse", F.expr("(q1 - s1 * s1 / n1) + ((q - q1) - (s - s1) * (s - s1) / (n - n1))"))
    return e.groupBy("k").agg(F.expr("min_by(i, round(sse, 0) * 1000 + i)").alias("split_at"))


@query("topk_partial", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def topk_partial(spark, d):
    """The largest 25 values; the limit is the operator."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)


@query("nearest_by_row", f"SELECT k, min_by(i, abs(x - 100000.0) * 1000000 + i) AS at FROM {_SERIES} GROUP BY k")
def nearest_by_row(spark, d):
    return _series(spark, d).groupBy("k").agg(F.expr("min_by(i, abs(x - 100000.0D) * 1000000 + i)").alias("at"))


@query("renumber", "SELECT c_custkey, coalesce(r, -1) AS new_no FROM customer LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer WHERE c_acctbal > 0) USING (c_custkey)")
def renumber(spark, d):
    """Dense numbers of the kept rows, -1 for the others."""
    from foliospark.operators.dictionary import dense_numbers

    c = table(spark, d, "customer")
    kept = dense_numbers(c.where("c_acctbal > 0").select("c_custkey"), "c_custkey", "r")
    return c.select("c_custkey").join(kept, "c_custkey", "left").select("c_custkey", F.coalesce("r", F.lit(-1).cast("bigint")).alias("new_no"))
