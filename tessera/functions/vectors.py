"""Quantised vectors as column expressions.

Vectors are arrays of whole numbers.  Distances are unrolled sums over a known number of
dimensions, which stay inside generated code; every term is widened before it is subtracted.
They are built as one SQL text over column names: a call for each term would cost more than the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quantised values are this times the float, clamped to plus or minus this.
SCALE = 10000


def quantize(x: Column) -> Column:
    """SC-7: times SCALE in double, clamped, rounded half away from zero, as smallint; NaN counts as 0."""
    return _whole(F.nanvl(x.cast("double"), F.lit(0.0)) * F.lit(float(SCALE)))


def _whole(x: Column) -> Column:
    """Doubles, clamped, rounded half away from zero.  Their halves are cut off and a little more than half of those goes to the nearest whole number:
    Spark's round goes by way of decimal texts, which costs more than all the rest of a feature, and this names x only once."""
    halves = (F.greatest(F.lit(-float(SCALE)), F.least(F.lit(float(SCALE)), x)) * F.lit(2.0)).cast("int")
    return F.rint(halves * F.lit(0.50001)).cast("smallint")


def round_to_smallint(x: Column) -> Column:
    """IVF-11: a centroid's mean, rounded half away from zero and clamped."""
    return _whole(x.cast("double"))


def quantize_array(x: Column) -> Column:
    return F.transform(x, quantize)


def squared_l2(a: str, b: str, dims: int) -> Column:
    """VEC-1: squared distance of two array columns as bigint."""
    terms = [f"(cast(get({a}, {i}) as bigint) - cast(get({b}, {i}) as bigint))" for i in range(dims)]
    return F.expr(" + ".join(f"{t} * {t}" for t in terms))


def box_bound(v: str, low: str, high: str, dims: int) -> Column:
    """VEC-3: squared distance from a vector to a box, which no vector inside is nearer than."""
    x = [tuple(f"cast(get({c}, {i}) as bigint)" for c in (v, low, high)) for i in range(dims)]
    gaps = [f"greatest(0L, {a} - {p}, {p} - {b})" for p, a, b in x]
    return F.expr(" + ".join(f"{g} * {g}" for g in gaps))


def score_body(count: Column) -> Column:
    """SNK-2: one of six fixed response bodies; counts over 5 saturate."""
    top = F.least(count.cast("int"), F.lit(5))
    return F.format_string('{"approved": %s, "fraud_score": %.2f}', (top <= 2).cast("string"), top / 5)


def fraud_score(count: Column) -> Column:
    """SC-11."""
    return (F.least(count.cast("int"), F.lit(5)) / 5).cast("decimal(3,2)")


def approved(count: Column) -> Column:
    """SC-12."""
    return count <= 2


def expected_count(score: Column) -> Column:
    """SC-13."""
    return F.round(score * 5).cast("int")
