"""Row-wise arithmetic with the missing-value rules of the data model.

Missing is always SQL NULL. Infinity may live between a ratio and ``finite_or_null``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The disguised-missing day count and the invalid category.
MISSING_DAYS = 365243
INVALID_GENDER = "XNA"

POS_INF = float("inf")


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio_ieee(a: Column | str, b: Column | str) -> Column:
    """``a / b`` where x/0 is a signed infinity, 0/0 is NULL and NULL spreads.

    The infinity has to survive until after aggregation, where it makes the client's
    value missing; ``try_divide`` would drop the row from the aggregate instead.
    """
    num, den = as_column(a).cast("double"), as_column(b).cast("double")
    at_zero = F.when(num > 0, F.lit(POS_INF)).when(num < 0, F.lit(-POS_INF))
    return F.when(den == 0, at_zero).otherwise(num / F.nullif(den, F.lit(0.0)))


def finite_or_null(c: Column | str) -> Column:
    """NULL for either infinity and for NaN."""
    x = as_column(c)
    return F.when(F.abs(x) < F.lit(POS_INF), x)


def is_infinite(c: Column | str) -> Column:
    return F.abs(as_column(c)) == F.lit(POS_INF)


def sentinel_to_null(c: Column | str, sentinel=MISSING_DAYS) -> Column:
    return F.nullif(as_column(c), F.lit(sentinel))


def sentinel_flag(c: Column | str, sentinel=MISSING_DAYS) -> Column:
    return as_column(c).eqNullSafe(F.lit(sentinel)).cast("int")


def not_sentinel(c: Column | str, sentinel=INVALID_GENDER) -> Column:
    """True also for NULL, which stays in the table."""
    return ~as_column(c).eqNullSafe(F.lit(sentinel))


def positive_part(c: Column | str) -> Column:
    """The value when above zero, else 0; NULL counts as 0."""
    x = as_column(c)
    return F.when(x > 0, x).otherwise(F.lit(0))


def _known_sum(columns: list[Column]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
    return total


def _known_count(columns: list[Column]) -> Column:
    n = F.lit(0)
    for c in columns:
        n = n + c.isNotNull().cast("int")
    return n


def row_mean(*columns: Column | str) -> Column:
    """Mean over the known values of one row; NULL when none is known."""
    cols = [as_column(c) for c in columns]
    n = _known_count(cols)
    return F.when(n > 0, _known_sum(cols) / F.nullif(n, F.lit(0)))


def row_std(*columns: Column | str) -> Column:
    """Sample standard deviation over the known values of one row; NULL below two."""
    cols = [as_column(c).cast("double") for c in columns]
    n = _known_count(cols)
    mean = row_mean(*cols)
    squares = _known_sum([(c - mean) * (c - mean) for c in cols])
    return F.when(n > 1, F.sqrt(squares / F.nullif(n - 1, F.lit(0))))


def age_years(days_birth: Column | str) -> Column:
    return -as_column(days_birth) / F.lit(365)


def days_past_due(entry: Column | str, due: Column | str) -> Column:
    return positive_part(as_column(entry) - as_column(due))


def days_before_due(entry: Column | str, due: Column | str) -> Column:
    return positive_part(as_column(due) - as_column(entry))


def late_flag(dpd: Column | str) -> Column:
    return F.coalesce(as_column(dpd) > 0, F.lit(False)).cast("int")


def guarded_ratio(a: Column, b: Column, default=None) -> Column:
    """``a / b``, with ``default`` (NULL unless given) where b is zero."""
    return F.when(b != 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(default).cast("double"))


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_column(x)))


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function for positive ``a``: Stirling's series at ``a + 16``, stepped back."""
    z = a + F.lit(16.0)
    steps = F.lit(0.0)
    for k in range(16):
        steps = steps + F.log(a + F.lit(float(k)))
    series = F.lit(1 / 12) / z - F.lit(1 / 360) / F.pow(z, F.lit(3.0)) + F.lit(1 / 1260) / F.pow(z, F.lit(5.0))
    return (z - F.lit(0.5)) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - steps


def gamma_tail(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for positive ``a`` and ``x >= 0``.

    Below ``a + 1`` by the power series of its complement, above by the continued fraction; both take a number of
    steps that grows with the root of ``a``.
    """
    steps = F.sequence(F.lit(1), (F.lit(200.0) + F.lit(10.0) * F.sqrt(a)).cast("int"))
    front = F.exp(a * F.log(x) - x - log_gamma(a))

    def term(acc: Column, n: Column) -> Column:
        t = acc["t"] * x / (a + n)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    first = F.lit(1.0) / a
    series = F.aggregate(steps, F.struct(first.alias("t"), first.alias("s")), term, lambda acc: acc["s"])

    def fraction(acc: Column, n: Column) -> Column:
        tiny = F.lit(1e-300)
        away = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
        an, b = -n * (n - a), acc["b"] + F.lit(2.0)
        d = F.lit(1.0) / away(an * acc["d"] + b)
        c = away(b + an / acc["c"])
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    b = x + F.lit(1.0) - a
    # evaluated below a + 1 too, where it is not used but must not fail
    d = F.lit(1.0) / F.greatest(b, F.lit(0.5))
    start = F.struct(b.alias("b"), F.lit(1e300).alias("c"), d.alias("d"), d.alias("h"))
    tail = F.aggregate(steps, start, fraction, lambda acc: acc["h"])
    upper = F.when(x < a + F.lit(1.0), F.lit(1.0) - front * series).otherwise(front * tail)
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), upper)))


def chi_square_tail(chi2: Column, dof: Column) -> Column:
    """Chance of a chi-square value this high or higher; 1 without a degree of freedom."""
    half = F.greatest(dof, F.lit(1)).cast("double") / F.lit(2.0)
    return F.when(chi2.isNull() | dof.isNull(), F.lit(None)).when(dof < 1, F.lit(1.0)).otherwise(gamma_tail(half, chi2 / F.lit(2.0)))
