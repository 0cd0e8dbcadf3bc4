"""Discrete Fourier transforms of long series in four steps, and what follows from them: n log n, and no task holds a series.

A series of N = P Q values is a table of P rows and Q columns. Its columns are transformed, turned by a factor that depends on the
place, and its rows transformed; between both lies a shuffle that transposes the table. A task transforms a tile: some whole
columns or rows, TILE values in all or one of them if that is longer (sqrt(N) values).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.functions.series import cut

#: Values of a tile.
TILE = 1 << 16


def size_for(values: Column) -> Column:
    """Binary logarithm of the smallest power of two that is no less than ``values`` (1 at least)."""
    bits = F.length(F.bin(F.greatest(values.cast("long"), F.lit(1)) - 1))  # bin(0) is '0'
    return F.when(values <= 1, 0).otherwise(bits).cast("int")


def _two(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent).cast("long")


def _step(df: DataFrame, channels: Sequence[str], sign: int, last: bool, tile: int) -> DataFrame:
    """Transforms along ``along`` for each ``across``; the first step also turns by the place."""
    parts = [f"{c}_{p}" for c in channels for p in ("re", "im")]

    def one(f: pd.DataFrame) -> pd.DataFrame:
        m = int(f["m"].iat[0])
        rows, cols = 1 << m // 2, 1 << (m - m // 2)
        length = cols if last else rows
        along, across = f["along"].to_numpy(), f["across"].to_numpy()
        first = across.min()
        width = int(across.max() - first) + 1
        k, other = np.arange(length)[:, None], np.arange(first, first + width)[None, :]
        out = {"series": f["series"].iat[0], "m": np.int32(m)}
        # the new place along becomes what is crossed next, and the other way round
        out["along"], out["across"] = (np.broadcast_to(v, (length, width)).ravel() for v in ((k, other) if last else (other, k)))
        turn = 1.0 if last else np.exp(sign * 2j * np.pi * (k * other) / (1 << m))
        for c in channels:
            table = np.zeros((length, width), complex)
            np.add.at(table, (along, across - first), f[f"{c}_re"].to_numpy() + 1j * f[f"{c}_im"].to_numpy())
            table = (np.fft.fft(table, axis=0) if sign < 0 else np.fft.ifft(table, axis=0, norm="forward")) * turn
            out[f"{c}_re"], out[f"{c}_im"] = table.real.ravel(), table.imag.ravel()
        return pd.DataFrame(out)

    half = F.shiftright("m", 1) if not last else F.col("m") - F.shiftright("m", 1)
    share = F.greatest(F.lit(1.0), F.lit(tile) / _two(half)).cast("long")
    shape = f"series string, m int, along long, across long, {', '.join(f'{p} double' for p in parts)}"
    return df.groupBy("series", "m", F.floor(F.col("across") / share).alias("_tile")).applyInPandas(one, shape)


def transform(df: DataFrame, channels: Sequence[str], sign: int = -1, tile: int = TILE) -> DataFrame:
    """series, m, idx, <c>_re, <c>_im: sum over t of x[t] exp(sign 2 pi i idx t / 2^m), idx = 0 .. 2^m - 1, for each channel c at once.

    df: series, m (one for each series), idx, <c>_re, <c>_im; rows that are absent count as zeros. Neither direction is scaled.
    """
    parts = [f"{c}_{p}" for c in channels for p in ("re", "im")]
    rows = _two(F.shiftright("m", 1))
    cols = _two(F.col("m") - F.shiftright("m", 1))
    d = df.select("series", "m", F.floor(F.col("idx") / cols).alias("along"), (F.col("idx") % cols).alias("across"), *parts)
    d = _step(_step(d, channels, sign, False, tile), channels, sign, True, tile)
    return d.select("series", "m", (F.col("across") + F.col("along") * rows).alias("idx"), *parts)


def _times(a: str, b: str, conj: bool = False) -> tuple[Column, Column]:
    """Real and imaginary part of a b, or of conj(a) b."""
    s = -1 if conj else 1
    re = F.col(f"{a}_re") * F.col(f"{b}_re") - s * F.col(f"{a}_im") * F.col(f"{b}_im")
    return re, F.col(f"{a}_re") * F.col(f"{b}_im") + s * F.col(f"{a}_im") * F.col(f"{b}_re")


def correlations(df: DataFrame, a: str, b: str, max_lag: int | None = None, tile: int = TILE) -> DataFrame:
    """series, lag, s, pairs: sums of a[t] b[t + lag] over the pairs without nulls, lag = 0 .. max_lag (n - 1 by default).

    s is NULL without pairs. Its error is some 1e-16 log2(n) of the product of both series' norms, whatever the size of s itself.
    Values and the places where there are some go through the same transforms, so that pairs are counted for each lag.
    """
    d = cut(df.select("series", "idx", F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")))
    n = d.groupBy("series").agg((F.max("idx") + 1).alias("n"))
    top = F.col("n") - 1 if max_lag is None else F.lit(max_lag).cast("long")
    n = n.select("series", top.alias("top"), size_for(F.col("n") + top).alias("m"))
    zero, one = F.lit(0.0), lambda c: F.col(c).isNotNull().cast("double")
    columns = {"a": F.coalesce("a", zero), "b": F.coalesce("b", zero), "u": one("a"), "v": one("b")}
    x = d.join(n, "series").select("series", "m", "idx", *[c for k, v in columns.items() for c in (v.alias(f"{k}_re"), zero.alias(f"{k}_im"))])
    f = transform(x, ["a", "b", "u", "v"], tile=tile)
    (s_re, s_im), (p_re, p_im) = _times("a", "b", True), _times("u", "v", True)
    # both results are real, so that one transform brings both back
    back = transform(f.select("series", "m", "idx", (s_re - p_im).alias("z_re"), (s_im + p_re).alias("z_im")), ["z"], 1, tile)
    out = back.join(n.select("series", "top"), "series").where(F.col("idx") <= F.col("top"))
    scale = _two(F.col("m"))
    pairs = F.round(F.col("z_im") / scale).cast("long")
    return out.select("series", F.col("idx").alias("lag"), F.when(pairs > 0, F.col("z_re") / scale).alias("s"), pairs.alias("pairs"))


def lowest(df: DataFrame, value: str, top: Column, tile: int = TILE) -> DataFrame:
    """series, n, k, re, im: sum over t of value[t] exp(-2 pi i k t / n), k = 1 .. top, for a series of any length n.

    df: series, idx (0 .. n - 1), n, value. As k t = (k^2 + t^2 - (k - t)^2) / 2, this is a convolution with exp(pi i j^2 / n),
    done by transforms of a power of two that holds n + top values. Squares stay longs, so n is below 3e9.
    """
    sizes = df.select("series", "n").groupBy("series", "n").agg(F.count("*").alias("rows")).withColumn("top", top.cast("long"))
    sizes = cut(sizes.where("top > 0").withColumn("m", size_for(F.col("n") + F.col("top"))))
    angle = lambda j: np.pi * ((j * j) % (2 * F.col("n"))) / F.col("n")
    t = F.col("idx")
    x = df.join(sizes.select("series", "top", "m"), "series").select(
        "series", "m", t.alias("at"), (F.col(value) * F.cos(angle(t))).alias("x_re"), (-F.col(value) * F.sin(angle(t))).alias("x_im"), F.lit(0.0).alias("c_re"), F.lit(0.0).alias("c_im")
    )
    # the chirp at j = 0 .. top, and at j = -1 .. 1 - n, which lie at the end; made in stretches of TILE places
    ends = F.floor((F.col("n") + F.col("top") - 1) / TILE)
    stretch = sizes.select("series", "m", "n", "top", F.explode(F.sequence(F.lit(0).cast("long"), ends)).alias("_s")).repartition("series", "_s")
    place = F.explode(F.sequence(F.col("_s") * TILE, F.least((F.col("_s") + 1) * TILE, F.col("n") + F.col("top")) - 1))
    j = stretch.select("series", "m", "n", place.alias("_p")).select("series", "m", "n", (F.col("_p") - F.col("n") + 1).alias("j"))
    at = F.when(F.col("j") < 0, _two(F.col("m")) + F.col("j")).otherwise(F.col("j"))
    chirp = j.select("series", "m", at.alias("at"), F.lit(0.0).alias("x_re"), F.lit(0.0).alias("x_im"), F.cos(angle(F.col("j"))).alias("c_re"), F.sin(angle(F.col("j"))).alias("c_im"))
    f = transform(x.unionByName(chirp).withColumnRenamed("at", "idx"), ["x", "c"], tile=tile)
    re, im = _times("x", "c")
    back = transform(f.select("series", "m", "idx", re.alias("z_re"), im.alias("z_im")), ["z"], 1, tile)
    k = F.col("idx")
    out = back.drop("m").join(sizes.select("series", "n", "top", "m"), "series").where((k >= 1) & (k <= F.col("top")))
    cos, sin, scale = F.cos(angle(k)), F.sin(angle(k)), _two(F.col("m"))
    z_re, z_im = F.col("z_re"), F.col("z_im")
    return out.select("series", "n", k.alias("k"), ((z_re * cos + z_im * sin) / scale).alias("re"), ((z_im * cos - z_re * sin) / scale).alias("im"))
