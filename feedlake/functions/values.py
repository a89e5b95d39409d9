"""Numbers and dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake.functions.vocabulary import BANDS


def round_half_up(x: Column) -> Column:
    """Halves go up, for negative numbers too."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clamp_score(x: Column) -> Column:
    """Into 0 to 100; what is no finite number is 0."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, clamp(x, 0.0, 100.0)).otherwise(0.0)


def band(score: Column, bands=BANDS) -> Column:
    rounded = round_half_up(clamp_score(score.cast("double")))
    out = None
    for least, name in bands:
        out = F.when(rounded >= least, name) if out is None else out.when(rounded >= least, name)
    return out


def ladder(x: Column, steps: list[tuple[float, float]], other=0) -> Column:
    """The points of the first step that x reaches, from the top."""
    out = None
    for least, points in steps:
        out = F.when(x >= least, points) if out is None else out.when(x >= least, points)
    return out.otherwise(other)


def days_between(earlier: Column, later: Column) -> Column:
    return (F.unix_millis(later) - F.unix_millis(earlier)) / F.lit(86_400_000.0)


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_millis(later) - F.unix_millis(earlier)) / F.lit(3_600_000.0)


def parse_date(text: Column) -> Column:
    """A timestamp; null where the text is no date."""
    return F.try_to_timestamp(text)


def non_negative(x: Column) -> Column:
    """A finite number of 0 or more, else null."""
    return F.when((x >= 0) & ~F.isnan(x.cast("double")) & (x.cast("double") != float("inf")), x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles, held in -1 to 1; null where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cos = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(cos.isNotNull() & ~F.isnan(cos), clamp(cos, -1.0, 1.0))


def valid_vector(v: Column, dimensions: int) -> Column:
    """Exact length and all finite."""
    return F.coalesce((F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: branches of a conditional would each compute it again."""
    return F.element_at(F.transform(F.array(x), f), 1)


def once(x: Column) -> Column:
    """x, computed once: the optimiser may copy a column's expression into every place that reads it, and a long chain
    of such copies takes minutes to plan. It does not copy what depends on the row's place. The price: no filter moves
    below such a column, so filter before the steps that use it."""
    return F.when(F.monotonically_increasing_id() >= 0, x)
