"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.schema import Calendar


def week_index(day: Column, cal: Calendar) -> Column:
    """Week number; floors, so days before the anchor get negative weeks."""
    return F.floor(F.datediff(day, F.lit(cal.anchor)) / F.lit(7)).cast("int")


def week_start(week: Column, cal: Calendar) -> Column:
    return F.date_add(F.lit(cal.anchor), (week * 7).cast("int"))


def week_end(week: Column, cal: Calendar) -> Column:
    return F.date_add(F.lit(cal.anchor), (week * 7 + 6).cast("int"))


def when_chain(value: Column, limits: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose inclusive upper limit holds ``value``."""
    chain = F.when(value <= limits[0][0], limits[0][1])
    for limit, label in limits[1:]:
        chain = chain.when(value <= limit, label)
    return chain.otherwise(otherwise)


def age_bucket(age: Column) -> Column:
    return (
        F.when(age.isNull() | F.isnan(age.cast("double")), "missing")
        .when(age < 25, "<25")
        .when(age < 35, "25-34")
        .when(age < 45, "35-44")
        .when(age < 55, "45-54")
        .otherwise("55+")
    )


def purchase_segment(count: Column) -> Column:
    return when_chain(count, [(0, "0"), (4, "1-4"), (19, "5-19")], "20+")


def recency_bucket(days: Column) -> Column:
    return F.when(days.isNull(), "never").otherwise(
        when_chain(days, [(7, "<=7"), (30, "8-30"), (90, "31-90")], "91+")
    )


def hash_uniform(seed: int, *parts: Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits of an md5; portable to other SQL engines."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return _hex_uniform(F.md5(text.cast("binary")), F.lit(1))


def _hex_uniform(digest: Column, start: Column) -> Column:
    return F.conv(F.substring(digest, start, F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


LANES = 4  # replicates served by one md5


def lane_digest(seed: int, unit: Column, block: Column) -> Column:
    """The md5 of one unit that serves replicates ``LANES * block`` and the three behind it."""
    text = F.concat_ws("|", unit.cast("string"), block.cast("string"), F.lit(str(seed)))
    return F.md5(text.cast("binary"))


def lane_uniform(digest: Column, lane: int | Column) -> Column:
    """Uniform of the lane's replicate: hex digits 8*lane+1 .. +8."""
    return _hex_uniform(digest, F.lit(lane * 8 + 1) if isinstance(lane, int) else (lane * 8 + 1).cast("int"))


# fixed values: cumulative Poisson(1) probabilities P(X <= n), n = 0..10
POISSON_CUMULATIVE = (
    0.36787944117144233,
    0.7357588823428847,
    0.9196986029286058,
    0.9810118431238462,
    0.9963401531726563,
    0.9994058151824183,
    0.999916758850712,
    0.9999897508033253,
    0.999998874797402,
    0.9999998885745217,
    0.9999999899522336,
)


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count whose cumulative probability first exceeds ``u``."""
    return sum(
        ((u >= F.lit(c)).cast("int") for c in POISSON_CUMULATIVE[1:]),
        (u >= F.lit(POISSON_CUMULATIVE[0])).cast("int"),
    )


# fixed values: Abramowitz-Stegun 7.1.26 error-function polynomial
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
Z_975 = 1.959963984540054
Z_80 = 0.8416212335729143


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function from the error-function polynomial."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(ERF_A[4])
    for a in reversed(ERF_A[:4]):
        poly = poly * t + F.lit(a)
    erf = F.lit(1.0) - poly * t * F.exp(-x * x)
    return F.when(z >= 0, (F.lit(1.0) + erf) / 2).otherwise((F.lit(1.0) - erf) / 2)


def two_sided_p(z: Column) -> Column:
    return F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z)))


def safe_ratio(num: Column, den: Column) -> Column:
    """Double division that yields null on a zero or null divisor (ANSI mode raises)."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def share_of(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))
