"""Scores as column arithmetic, with their constants as defaults."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_score(listens: Column, tracks: Column, years: Column) -> Column:
    return F.log(listens + 1) * F.least(tracks / 5, F.lit(3.0)) * F.pow(F.lit(0.5), years / 2)


def affinity(listens: Column, weight: float, cap: int = 500) -> Column:
    return 1 + F.lit(weight) * F.least(F.log1p(listens) / F.lit(math.log(cap + 1)), F.lit(1.0))


def position_factor(position: Column, size: Column, last: float = 0.5) -> Column:
    """1 for the first place, last for the last one."""
    return F.when(size > 1, 1 - (1 - last) * (position - 1) / (size - 1)).otherwise(F.lit(1.0))


def damp(n: Column, scale: int = 10) -> Column:
    return 1 / (1 + F.log(1 + n / scale))


def listen_factor(sessions: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * sessions)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def near_year(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= 1, F.lit(True))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400e6
