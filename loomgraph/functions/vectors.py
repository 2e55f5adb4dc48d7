"""Vectors as array<double> columns: products, norms, cosines, sums by group. All accumulate in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6
#: Elements that one aggregate has expressions for; longer vectors are summed in stretches of as many.
STRETCH = 64


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def rounded(x: Column, digits: int = DIGITS) -> Column:
    """Rounded, and without a negative zero, so that ties are ties in any engine."""
    r = F.round(x, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def normalised(a: Column, eps: float = 1e-6) -> Column:
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x / n)


def element_sums(v: Column, size: int, agg=F.sum, weight: Column | None = None) -> Column:
    """An aggregate of arrays, element by element, as one array: partial sums combine before the shuffle."""
    return F.array(*(agg(v[i] if weight is None else v[i] * weight) for i in range(size)))


def group_sums(df: DataFrame, by: list[str], size: int, agg=F.sum, weight: Column | None = None, name: str = "e") -> DataFrame:
    """(by, name): e of df, of size elements, aggregated element by element in each group.

    A vector longer than STRETCH becomes a row for each stretch, so that a plan has as many
    expressions at 4096 elements as at 64, and a hot group is shared among as many tasks as it has
    stretches. An element's sum takes the same rows in either way.
    """
    if size <= STRETCH:
        return df.groupBy(*by).agg(element_sums(F.col("e"), size, agg, weight).alias(name))
    n = -(-size // STRETCH)
    cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.slice(F.col("e"), k * STRETCH + 1, F.lit(STRETCH)))
    rows = df.select(*by, *([] if weight is None else [weight.alias("__weight")]), F.posexplode(cut).alias("__stretch", "__part"))
    part = F.col("__part")
    one = [agg(F.get(part, F.lit(i)) if weight is None else F.get(part, F.lit(i)) * F.col("__weight")) for i in range(STRETCH)]
    sums = rows.groupBy(*by, "__stretch").agg(F.array(*one).alias("__sums"))
    ordered = F.array_sort(F.collect_list(F.struct("__stretch", "__sums")))  # n stretches a group
    return sums.groupBy(*by).agg(F.slice(F.flatten(F.transform(ordered, lambda s: s["__sums"])), 1, size).alias(name))


def pad(a: Column, length: int, value) -> Column:
    """First length elements, filled up on the right."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(value), length)), 1, length)
