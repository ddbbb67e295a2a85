"""Scalar expressions. All are built-in column functions; bad input gives NULL."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

OPEN, CLOSE = 34_200, 57_600
HALF_HOUR = 1_800


def number(x: Column) -> Column:
    """Lenient cast to double; NaN and infinities become NULL."""
    return finite(x.try_cast("double"))


def finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def part(n: Column, share: float) -> Column:
    """Whole part of a share of a count, by the decimal as written: 0.7 of 1440 is 1008, which doubles put just below."""
    return F.floor(n.cast("decimal(20,0)") * F.lit(Decimal(str(share)))).cast("long")


def part_of(n: int, share: float) -> int:
    """:func:`part` of a number."""
    return int(Decimal(str(share)) * int(n))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0))


def log(x: Column) -> Column:
    """Natural logarithm of positive values, else NULL."""
    return F.when(x > 0, F.ln(x))


def log_return(x: Column, order: WindowSpec) -> Column:
    """log(x / previous x), NULL on the first row."""
    return log(ratio(x, F.lag(x).over(order)))


def signed_power(x: Column, delta: float | Column) -> Column:
    """sign(x) * abs(x) ** delta."""
    return F.signum(x) * F.pow(F.abs(x), delta if isinstance(delta, Column) else F.lit(delta))


def aggressor_sign(side: Column) -> Column:
    """+1 for B, -1 for A, 0 for anything else: the side code names the aggressor."""
    return F.when(side == "B", 1).when(side == "A", -1).otherwise(0)


def from_resting(direction: Column) -> Column:
    """Aggressor sign of a fill whose ``direction`` is the resting side."""
    return -direction


def price(fixed: Column, unit: float = 1e-4) -> Column:
    """Fixed-point price in currency; ``unit`` is 1e-4 or 1e-9."""
    return fixed * F.lit(unit)


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def half_spread(bid: Column, ask: Column) -> Column:
    return (ask - bid) / 2


def exchange_second(ts: Column, zone: str = "America/New_York") -> Column:
    """Seconds since midnight on the exchange's clock."""
    local = F.from_utc_timestamp(ts, zone)
    return (F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)).cast("long")


def bin_index(seconds: Column, milliseconds: int) -> Column:
    """Number of the bin since midnight, by whole microseconds."""
    micros = F.bround(seconds * 1_000_000).cast("long")
    return F.floor(micros / (milliseconds * 1000)).cast("long")


def bin_start(seconds: Column, milliseconds: int) -> Column:
    """Start of the bin in seconds; an integer where the bin is whole seconds."""
    k = bin_index(seconds, milliseconds)
    return k * (milliseconds // 1000) if milliseconds % 1000 == 0 else k * F.lit(milliseconds) / 1000


def grid(sec: Column, width: int, origin: int = OPEN) -> Column:
    """Index of a fixed grid since the open; negative before it."""
    return F.floor((sec - origin) / width).cast("long")


def impact_log(sign: Column, start: Column, end: Column) -> Column:
    return sign * (log(end) - log(start))


def impact_simple(sign: Column, start: Column, end: Column) -> Column:
    return sign * ratio(end - start, start)


def blend(daily: Column, trailing: Column, alpha: float | Column) -> Column:
    """Geometric blend of two volatilities."""
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    return F.pow(daily, a) * F.pow(trailing, 1 - a)


def sqrt_impact(c: Column, sigma: Column, q: Column) -> Column:
    return c * sigma * F.sqrt(q)


def power_impact(c: Column, delta: Column, sigma: Column, q: Column) -> Column:
    return c * sigma * F.pow(q, delta)


def rate_impact(c: Column, delta: Column, k: Column, sigma: Column, q: Column, rate: Column) -> Column:
    return sigma * c * F.pow(q, delta) * (1 + k * log(rate))


def two_regime(a: Column, q_star: Column, q: Column) -> Column:
    """Linear up to q_star, square root beyond, continuous."""
    return a * F.when(q <= q_star, q).otherwise(F.sqrt(q_star * q))


def propagator_impact(kernel: Column, shares: Column, sign: Column, seconds: Column, delta: float | Column) -> Column:
    """Summed response of an order spread evenly over ``seconds``, times its sign.

    ``kernel``: array of return responses; lag l acts on seconds - l slices.
    """
    slices = F.greatest(seconds, F.lit(1.0))
    flow = signed_power(sign * shares / slices, delta)
    total = F.aggregate(
        F.transform(kernel, lambda g, l: F.greatest(slices - l, F.lit(0.0)) * g),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return sign * flow * total


def clipped_rate(shares: Column, volume: Column) -> Column:
    """Participation rate within [1e-6, 1]; NULL without volume."""
    return F.when(volume > 0, F.least(F.greatest(shares / volume, F.lit(1e-6)), F.lit(1.0)))


def first_depth(sizes: Column) -> Column:
    """First positive size of an array, else 0."""
    return F.coalesce(F.get(F.filter(sizes, lambda x: x > 0), F.lit(0)), F.lit(0.0))


def ticker(x: Column) -> Column:
    return F.translate(F.upper(F.trim(x)), ".", "-")


def session_key(symbol: Column, date: Column) -> Column:
    return F.concat_ws("_", symbol, F.date_format(date, "yyyy-MM-dd"))


def session_symbol(key: Column) -> Column:
    return F.regexp_extract(key, r"^(.*)_(\d{4}-\d{2}-\d{2})$", 1)


def session_date(key: Column) -> Column:
    return F.to_date(F.regexp_extract(key, r"^(.*)_(\d{4}-\d{2}-\d{2})$", 2))


def saving(benchmark: Column, cost: Column) -> Column:
    """Percent saved against the benchmark."""
    return 100 * ratio(benchmark - cost, benchmark)


def schedule_cost(shares: Column, coefficient: Column) -> Column:
    """Cost of one slice under a square-root price: a * x ** 1.5."""
    return coefficient * F.pow(shares, F.lit(1.5))


def piecewise_cost(shares: Column, depth: Column, c: float, p: float) -> Column:
    """Cost of one slice: flat within the depth, a power of size beyond."""
    return shares * F.when(shares <= depth, F.lit(c)).otherwise(c * F.pow(shares / depth, F.lit(p)))


def significant(x: Column, digits: int = 12) -> Column:
    """``x`` at so many significant decimal digits, as a key for ties."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits - 1}e", x).cast("double"))


def z_score(x: Column, window: WindowSpec) -> Column:
    """(x - mean) / population standard deviation."""
    return ratio(x - F.avg(x).over(window), F.stddev_pop(x).over(window))


def band_text(low: Column, high: Column, digits: int = 3) -> Column:
    return F.format_string(f"[%.{digits}f, %.{digits}f]", low, high)


def verdict(exponent: Column, r2: Column) -> Column:
    """One line on a fitted impact exponent."""
    kind = F.when(F.abs(exponent - 0.5) <= 0.1, "consistent with a square root").when(exponent < 0.4, "flatter than a square root").otherwise("steeper than a square root")
    return F.format_string("exponent %.3f (R2 %.3f): %s", exponent, r2, kind)


def crossover_ticks(a: Column, q_star: Column, sigma: Column, price_: Column, tick: float = 0.01) -> Column:
    """The impact at the crossover in daily volatilities, currency and ticks."""
    at = a * q_star
    money = at * sigma * price_
    return F.struct(q_star.alias("q_star"), at.alias("impact_sigma"), money.alias("impact_money"), (money / tick).alias("impact_ticks"), F.lit(0.5).alias("half_tick"), (money / tick > 1).alias("above_one_tick"))


def running(values: Column) -> Column:
    """Running sums of an array."""
    return F.transform(
        F.sequence(F.lit(1), F.size(values)),
        lambda k: F.aggregate(F.slice(values, F.lit(1), k), F.lit(0.0), lambda acc, x: acc + x),
    )


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def in_regular_hours(sec: Column, start: int = OPEN, end: int = CLOSE) -> Column:
    return (sec >= start) & (sec < end)


def all_finite(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & finite(F.col(c)).isNotNull()
    return out
