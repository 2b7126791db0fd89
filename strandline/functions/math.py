"""Scalar arithmetic on times, scores and vectors, all as JVM expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def num(c: Column, default: float | None = None) -> Column:
    """Lenient number: NULL or unparsable text gives ``default``."""
    return F.coalesce(c.try_cast("double"), F.lit(default).cast("double"))


def ms(c: Column) -> Column:
    """Whole milliseconds, halves up; equal in every engine, unlike rounded doubles."""
    return F.floor(c * 1000 + 0.5).cast("bigint")


def fraction(c: Column) -> Column:
    """``24000/1001`` as a double; NULL without a slash, for bad parts or a zero denominator."""
    parts = F.split(c, "/")
    top, low = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 2, F.try_divide(top, low))


def duration(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), end - start)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, c))


def band_score(d: Column, low: float, high: float) -> Column:
    """1 inside [low, high], falling off in proportion on both sides, 0 for no length."""
    return F.when(d <= 0, 0.0).when(d < low, d / low).when(d > high, F.lit(float(high)) / d).otherwise(1.0)


def proximity_score(mid: Column, t: Column, sigma: float) -> Column:
    s = max(1.0, float(sigma))
    return F.exp(-((mid - t) * (mid - t)) / F.lit(2 * s * s))


def quantise(d: Column, fps: Column) -> tuple[Column, Column]:
    """(exact length, length to ask for) in whole frames; unchanged without a frame rate."""
    frames = F.greatest(F.lit(1.0), F.bround(d * fps))
    usable = fps.isNotNull() & (fps > 0)
    return F.when(usable, frames / fps).otherwise(d), F.when(usable, (frames + 0.5) / fps).otherwise(d)


def spoiler_ceiling(t: Column, next_twist: Column, runtime: Column, lookahead: float) -> Column:
    """Latest second that a line about ``t`` may show; ``next_twist`` is the first twist after ``t``."""
    open_end = F.least(runtime, t + max(0.0, lookahead))
    held = F.when(next_twist.isNull(), open_end).otherwise(F.least(open_end, F.greatest(t, next_twist - 2.0)))
    return F.greatest(t, held)


def content_span(first_cue: Column, last_cue: Column, runtime: Column, lead: float = 10.0, trail: float = 20.0) -> tuple[Column, Column]:
    """Where titles end and credits begin; the whole source if unknown or inverted."""
    low = F.greatest(F.lit(0.0), first_cue - lead)
    high = F.least(runtime, last_cue + trail)
    ok = first_cue.isNotNull() & last_cue.isNotNull() & (high > low)
    return F.when(ok, low).otherwise(0.0), F.when(ok, high).otherwise(runtime)


def est_seconds(words: Column, wpm: float) -> Column:
    return words / F.lit(max(1.0, float(wpm))) * 60.0


def even(c: Column) -> Column:
    return c - F.pmod(c, F.lit(2))


def l2_normalise(v: Column) -> Column:
    """Unit length in double precision; a zero vector stays zero."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def realtime_factor(runtime: Column, total: Column) -> Column:
    return F.try_divide(runtime, F.nullif(total, F.lit(0.0)))


def progress_pct(done: Column, total: Column) -> Column:
    return F.least(F.lit(100.0), F.coalesce(F.try_divide(done, total), F.lit(0.0)) * 100)


def wpm(words: Column, spoken: Column) -> Column:
    return words / F.greatest(F.lit(1e-6), spoken / 60.0)


def py_round(digits: int):
    """Python's own rounding, for exact agreement with figures made in Python."""

    @F.pandas_udf("double")
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else round(float(v), digits))

    return rounded


def min_max_rescale(c: Column, window, least: float = 1e-6) -> Column:
    """Rescale to [0, 1] over the window; left alone when the values hardly differ."""
    low, high = F.min(c).over(window), F.max(c).over(window)
    return F.when(high - low > least, (c - low) / (high - low)).otherwise(c)


def retry_delay(attempt: Column, advice: Column) -> Column:
    """Seconds before attempt number ``attempt`` (from 0) is repeated: the other side's advice up to 120, else 4 doubling to 60."""
    return F.coalesce(F.least(F.lit(120.0), advice.try_cast("double")), F.least(F.lit(60.0), F.pow(F.lit(2.0), attempt) * 4.0))
