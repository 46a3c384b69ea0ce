"""Vector arithmetic on array columns, in doubles, on the JVM: higher-order functions, whose lambdas Spark interprets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0 or a component is missing."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def max_shift(a: Column, b: Column) -> Column:
    """Largest absolute difference of components."""
    return F.array_max(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def project_linf(moved: Column, origin: Column, eps: float) -> Column:
    """Each component back within eps of the origin and within [0, 1]."""
    e = F.lit(eps)
    return F.zip_with(doubles(moved), doubles(origin), lambda x, o: clamp(clamp(x, o - e, o + e), F.lit(0.0), F.lit(1.0)))


def signed_step(x: Column, gradient: Column, eps: float, iterations: int) -> Column:
    """One step of 2.5 * eps / iterations against the sign of the gradient."""
    size = F.lit(2.5 * eps / iterations)
    return F.zip_with(doubles(x), doubles(gradient), lambda a, g: a - size * F.signum(g))


def linf_bound(eps: float) -> Column:
    """The shift that quantised pixels may show for a bound of eps."""
    return F.ceil(F.lit(eps * 255.0)) / F.lit(255.0) + F.lit(1e-4)


def loss_weights(*distances: Column) -> list[Column]:
    """Each distance over their sum (kept from 0)."""
    total = distances[0]
    for d in distances[1:]:
        total = total + d
    return [d / (total + F.lit(1e-6)) for d in distances]


def traced(step: Column, last: Column) -> Column:
    """Steps that a trace keeps: every tenth and the last."""
    return (step % 10 == 0) | (step == last)


def standardised(v: Column, mean: list[float], std: list[float]) -> Column:
    """(x - mean) / std by channel; v holds one value a channel."""
    m, s = F.array(*[F.lit(float(x)) for x in mean]), F.array(*[F.lit(float(x)) for x in std])
    return F.zip_with(F.zip_with(doubles(v), m, lambda x, y: x - y), s, lambda x, y: x / y)
