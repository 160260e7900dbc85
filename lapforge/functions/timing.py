"""Expressions on lap times."""

from pyspark.sql import Column, functions as F

from lapforge.constants import SECTOR_COLS, SPEED_COLS, TARGET


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_lap_time(seconds: str | Column) -> Column:
    """m:ss.mmm; a remainder that rounds up prints as 60.000."""
    s = _c(seconds)
    minutes = F.floor(s / 60)
    return F.when(s.isNotNull(), F.format_string("%d:%06.3f", minutes, s - minutes * 60))


def avg_speed() -> Column:
    return sum((F.col(c) for c in SPEED_COLS[1:]), F.col(SPEED_COLS[0])) / 3


def sector_sum() -> Column:
    return sum((F.col(c) for c in SECTOR_COLS[1:]), F.col(SECTOR_COLS[0]))


def sector_delta() -> Column:
    """Distance between the lap time and its three sectors."""
    return F.abs(F.col(TARGET) - sector_sum())


def lap_progress(lap: str | Column, max_lap: str | Column, default: int = 70) -> Column:
    return F.least(_c(lap) / F.coalesce(_c(max_lap), F.lit(default)), F.lit(1.0))


def signed_delta(value: str | Column, base: str | Column, digits: int = 3) -> Column:
    """Difference with its sign in front, e.g. +0.412."""
    return F.format_string(f"%+.{digits}f", _c(value) - _c(base))


def hour_from_parts(year, month, day, hour) -> Column:
    """UTC hour from its parts; null when the parts name no real hour."""
    y, m, d, h = (_c(x).cast("int") for x in (year, month, day, hour))
    return F.try_make_timestamp(y, m, d, h, F.lit(0), F.lit(0).cast("decimal(8,6)"))
