"""Array functions of the numeric library as higher-order Catalyst expressions.

Arrays are columns of numbers. Positions count from 0. Null in, null out;
what is not defined for empty arrays is 0, as in the library.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

def _zero() -> Column:
    return F.lit(0.0)


def total(a: Column) -> Column:
    return F.aggregate(a, _zero(), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return F.when(F.size(a) == 0, _zero()).otherwise(total(a) / F.size(a))


def squares(a: Column) -> Column:
    return F.aggregate(a, _zero(), lambda s, x: s + x.cast("double") * x.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(squares(a))


def variance(a: Column) -> Column:
    """Population variance."""
    m = mean(a)
    return F.when(F.size(a) == 0, _zero()).otherwise(total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; 0 if the lengths differ."""
    return F.when(F.size(a) != F.size(b), _zero()).otherwise(total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, _zero()).otherwise(dot(a, b) / n)


def direct_product(a: Column, b: Column, alpha: float) -> Column:
    """(|a||b|)^alpha times the cosine."""
    return F.pow(norm(a) * norm(b), F.lit(alpha)) * cosine(a, b)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def root_mean_square(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == 0, _zero()).otherwise(F.sqrt(squared_distance(a, b) / F.size(a)))


def weighted_sum(a: Column, w: Column) -> Column:
    return total(F.zip_with(a, w, lambda x, y: x.cast("double") * y))


def weighted_squares(a: Column, w: Column) -> Column:
    return total(F.zip_with(a, w, lambda x, y: x.cast("double") * x * y))


def normalized_sum(a: Column) -> Column:
    t = total(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(t == 0, 1.0).otherwise(t))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def shifted_dot(a: Column, b: Column, shift: int) -> Column:
    """Products of a[i + shift] and b[i] over the common part."""
    n = F.least(F.size(a) - shift, F.size(b))
    return F.when(n <= 0, _zero()).otherwise(total(F.zip_with(F.slice(a, F.lit(shift + 1), F.greatest(n, F.lit(0))), F.slice(b, F.lit(1), F.greatest(n, F.lit(0))), lambda x, y: x.cast("double") * y)))


def convolve(a: Column, b: Column) -> Column:
    """All size(a) + size(b) - 1 sums of a[i] b[k - i]."""
    k = F.sequence(F.lit(0), F.size(a) + F.size(b) - 2)
    return F.transform(
        k,
        lambda k: F.aggregate(
            F.sequence(F.greatest(F.lit(0), k - F.size(b) + 1), F.least(k, F.size(a) - 1)), _zero(), lambda s, i: s + F.get(a, i).cast("double") * F.get(b, k - i)
        ),
    )


def multiply_add(a: Column, b: Column, factor: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y * factor)


def orthogonal(a: Column, b: Column) -> Column:
    """a without its part along b."""
    n = squares(b)
    p = F.when(n == 0, _zero()).otherwise(dot(a, b) / n)
    return F.zip_with(a, b, lambda x, y: x.cast("double") - p * y)


def entropy(a: Column) -> Column:
    """Natural entropy of the weights, normalised to 1; zeros add nothing."""
    t = total(a)
    return F.aggregate(a, _zero(), lambda s, x: F.when(x > 0, s - x / t * F.log(x / t)).otherwise(s))


def states(a: Column) -> Column:
    return F.exp(entropy(a))


def position_of_min(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("bigint")


def position_of_max(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("bigint")


def position_of(a: Column, value) -> Column:
    return (F.array_position(a, value) - 1).cast("bigint")


def closest(a: Column, value: float) -> Column:
    """The first position whose value is nearest."""
    gaps = F.transform(a, lambda x: F.abs(x.cast("double") - value))
    return position_of_min(gaps)


def count_of(a: Column, value) -> Column:
    return F.size(F.filter(a, lambda x: x == value)).cast("bigint")


def nonzero(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x != 0)).cast("bigint")


def sign(a: Column) -> Column:
    """1 for zero too."""
    return F.transform(a, lambda x: F.when(x < 0, -1.0).otherwise(1.0))


def clamp(a: Column, low: float, high: float) -> Column:
    return F.transform(a, lambda x: F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high)))


def running(a: Column) -> Column:
    """Running sums."""
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda n: total(F.slice(a, F.lit(1), n)))


def interpolated(a: Column, at: float) -> Column:
    """Linear between neighbours, clamped to the ends."""
    i = int(at // 1)
    last = F.size(a) - 1
    low, high = F.get(a, F.least(F.greatest(F.lit(i), F.lit(0)), last)), F.get(a, F.least(F.greatest(F.lit(i + 1), F.lit(0)), last))
    return low.cast("double") + (high.cast("double") - low) * (at - i)


def real_index(a: Column, value: float) -> Column:
    """The index, with its fraction, at which an ascending array reaches a value; clamped to the ends."""
    below = F.size(F.filter(a, lambda x: x <= value))
    low, high = F.get(a, below - 1).cast("double"), F.get(a, below).cast("double")
    return F.when(below == 0, _zero()).when(below == F.size(a), (below - 1).cast("double")).otherwise(below - 1 + (value - low) / (high - low))


def decimate(a: Column, step: int) -> Column:
    return F.filter(a, lambda x, i: i % step == 0)


def gather(a: Column, at: Column) -> Column:
    return F.transform(at, lambda i: F.get(a, i.cast("int")))


def inverse_permutation(p: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (F.array_position(p, i.cast("bigint")) - 1).cast("bigint"))


def sort_permutation(a: Column) -> Column:
    """Positions in the order of the values; of equal values the first comes first."""
    pairs = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda s: s["i"].cast("bigint"))


def starts_increasing(a: Column) -> Column:
    """Looks at the first two elements only."""
    return F.coalesce(F.get(a, F.lit(1)) > F.get(a, F.lit(0)), F.lit(False))


def linspace(start: float, end: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + i * ((end - start) / max(1, n - 1)))


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """The bin of [low, high), -1 outside."""
    return F.when((x >= low) & (x < high), F.floor((x - low) / ((high - low) / bins))).otherwise(-1).cast("bigint")


def clamped_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """The bin of [low, high]; the right edge falls into the last bin."""
    return F.when((x >= low) & (x <= high), F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1))).otherwise(-1).cast("bigint")
