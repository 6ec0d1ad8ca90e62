"""Expressions that several operators share. All are plain columns, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creasework import config as C


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def sum_if(cond: Column, value: str | Column) -> Column:
    return F.sum(F.when(cond, col(value)).otherwise(0))


def round_even(c: Column, digits: int) -> Column:
    """Scaled, rounded half to even, scaled back, as array libraries do it: 9.075 is 907.49.. hundredths and gives 9.07,
    2.675 is 267.5 hundredths and gives 2.68. (Spark's bround takes the shortest decimal text of a double instead.)"""
    scale = F.lit(10.0**digits)
    return F.rint(c * scale) / scale


def round_half_up(c: Column, digits: int) -> Column:
    """Scaled, rounded with halves away from zero, scaled back."""
    scale = F.lit(10.0**digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def ratio(num: str | Column, den: str | Column, scale: float = 1.0, digits: int | None = 2) -> Column:
    """num * scale / den, null where den is not positive; rounded half to even."""
    out = F.when(col(den) > 0, col(num) * F.lit(float(scale)) / col(den))
    return out if digits is None else round_even(out, digits)


def over_one(num: str | Column, den: str | Column, scale: float = 1.0, digits: int | None = 2) -> Column:
    """num * scale / den with the denominator clamped to at least 1."""
    out = col(num) * F.lit(float(scale)) / F.greatest(col(den), F.lit(1))
    return out if digits is None else round_even(out, digits)


def clamp(c: str | Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(float(low))), F.lit(float(high)))


def phase_of(over: str | Column) -> Column:
    """0 powerplay, 1 middle, 2 anything else (overs beyond 20 too)."""
    return F.when(col(over).between(*C.POWERPLAY), 0).when(col(over).between(*C.MIDDLE), 1).otherwise(2)


def phase_name(phase: str | Column) -> Column:
    return F.when(col(phase) == 0, "powerplay").when(col(phase) == 1, "middle").otherwise("death")


def is_legal() -> Column:
    return (F.col("wide") == 0) & (F.col("no_ball") == 0)


def bowler_wicket() -> Column:
    """Wickets credited to the bowler; a wicket of unknown kind is."""
    return F.col("is_wicket") & ~F.coalesce(F.col("wicket_kind").isin(*C.NOT_BOWLER), F.lit(False))


def default(c: str | Column, value: float) -> Column:
    """value where c is null or zero."""
    return F.coalesce(F.nullif(col(c), F.lit(0)), F.lit(value))


def sigmoid_score(z: Column) -> Column:
    return 100 / (1 + F.exp(-0.8 * z))


def pitch_label(bat_factor: str = "bat_factor", pace: str = "pace_index", boundary: str = "boundary_rate") -> Column:
    b, p, r = col(bat_factor), col(pace), col(boundary)
    scoring = F.when(b.isNull(), "Unknown scoring").when(b > 1.10, "High-scoring").when(b < 0.90, "Low-scoring").otherwise("Balanced scoring")
    surface = F.when(p.isNull(), "unknown surface").when(p > 0.65, "pace-friendly surface").when(p < 0.35, "spin-friendly surface").otherwise("balanced surface")
    size = F.when(r.isNull(), "").when(r > 0.16, " Short boundaries.").when(r < 0.10, " Large ground.").otherwise(" Standard dimensions.")
    return F.concat(scoring, F.lit(" · "), surface, F.lit("."), size)


def grade(score: str | Column) -> Column:
    s = col(score)
    return F.when(s >= 80, "A+").when(s >= 72, "A").when(s >= 65, "B+").when(s >= 58, "B").when(s >= 50, "C+").otherwise("C")


def venue_adjusted(raw: str | Column, factor: str | Column) -> Column:
    """raw / factor; raw itself where the factor is null or not positive."""
    return F.when(col(factor) > 0, col(raw) / col(factor)).otherwise(col(raw))
