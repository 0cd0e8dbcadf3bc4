"""Row-local column functions of the signed-flow operators. Missing values are NULL throughout, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """``x`` with NaN and infinities as NULL."""
    x = x.cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def log(x: Column) -> Column:
    """Natural logarithm, NULL for x <= 0."""
    return F.when(x > 0, F.ln(x))


def flow_imbalance(tb_base: Column, volume: Column, normalize: str = "volume") -> Column:
    """Signed flow 2*tb - V, as a share of the volume clipped to [-1, 1] (0 without volume) or raw."""
    raw = 2 * tb_base - volume
    if normalize == "none":
        return raw
    if normalize != "volume":
        raise ValueError(f"unknown normalize: {normalize!r}")
    return F.when(volume > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(raw, volume)))).otherwise(0.0)


def volatility_field(r: Column, field: str = "abs") -> Column:
    if field not in ("abs", "sq", "raw"):
        raise ValueError(f"unknown field: {field!r}")
    return {"abs": F.abs(r), "sq": r * r, "raw": r}[field]


def logistic(eta: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))))


def log_loss(p: Column, y: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def qlike(rv: Column, sigma: Column) -> Column:
    """QLIKE loss of one forecast; NULL unless both are positive."""
    x = ratio(rv * rv, sigma * sigma)
    return F.when((rv > 0) & (sigma > 0), x - F.ln(x) - 1)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, to double precision: the series of erf below 2.5, a continued fraction above."""
    small, large = F.least(x, F.lit(2.5)), F.greatest(x, F.lit(2.5))
    fold = lambda terms, step: F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(1.0), step)
    # erf(x) = 2 x exp(-x^2) / sqrt(pi) * (1 + 2 x^2 / 3 (1 + 2 x^2 / 5 (1 + ...)))
    series = fold(60, lambda acc, k: 1 + acc * 2 * small * small / (2 * k + 1))
    near = 1 - 2 / math.sqrt(math.pi) * small * F.exp(-small * small) * series
    # erfc(x) = exp(-x^2) / (x sqrt(pi)) / (1 + 1/(2x^2) / (1 + 2/(2x^2) / (1 + ...)))
    fraction = fold(80, lambda acc, k: 1 + k / (2 * large * large) / acc)
    return F.when(x < 2.5, near).otherwise(F.exp(-large * large) / (large * math.sqrt(math.pi)) / fraction)


def phase_bin(hour: Column, n_bins: int) -> Column:
    """The hour's bin of 24 // n_bins hours; NULL for the hours left over where n_bins does not divide 24. Raises outside 1..24 bins."""
    if not 1 <= n_bins <= 24:
        raise ValueError("a day has 1 to 24 phase bins")
    b = F.floor(hour / (24 // n_bins)).cast("int")
    return F.when(b < n_bins, b)


def phase_label(b: Column, n_bins: int) -> Column:
    width = 24 // n_bins
    return F.format_string("%02d-%02d", b * width, (b + 1) * width)


def market_symbol(ticker: Column) -> Column:
    """Exchange symbol of a ticker: marks dropped, a trailing -USD becomes USDT."""
    bare = F.regexp_replace(ticker, "[-=]", "")
    return F.when(ticker.endswith("-USD"), F.concat(bare, F.lit("T"))).otherwise(bare)


def draw_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def draw_int(*parts: Column) -> Column:
    """Reproducible 32-bit random integer of a key; the same in any engine with MD5."""
    return F.conv(F.substring(draw_key(*parts), 1, 8), 16, 10).cast("long")


def digamma(x: Column) -> Column:
    """psi(x), x > 0: recurrence to x + 6, then the asymptotic series."""
    y = x + 6
    steps = sum((1 / (x + k) for k in range(1, 6)), 1 / x)
    inv2 = 1 / (y * y)
    series = inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 / 132))))
    return F.ln(y) - 0.5 / y - series - steps


def trigamma(x: Column) -> Column:
    """psi'(x), x > 0."""
    y = x + 6
    steps = sum((1 / ((x + k) * (x + k)) for k in range(1, 6)), 1 / (x * x))
    inv2 = 1 / (y * y)
    series = (1 / y) * (1 + 0.5 / y + inv2 * (1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 / 30))))
    return series + steps
