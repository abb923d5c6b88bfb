"""Integer seconds since the start of a simulation, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import ConfigError

DAY = 86_400
HOUR = 3_600
NIGHT_HOURS = 5


def _c(ts: Column | str) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


def day_of(ts: Column | str) -> Column:
    """Number of the day; floors also before the start."""
    return F.floor(_c(ts) / DAY)


def hour_of(ts: Column | str) -> Column:
    return F.floor(F.pmod(_c(ts), F.lit(DAY)) / HOUR)


def is_weekend(ts: Column | str) -> Column:
    """Day 0 is a Monday."""
    return F.pmod(day_of(ts), F.lit(7)) >= 5


def is_night(ts: Column | str) -> Column:
    return F.pmod(_c(ts), F.lit(DAY)) < NIGHT_HOURS * HOUR


def snapshot_cutoff(day: Column | int):
    """The last second before day d: a snapshot of day d sees the days before it only."""
    return day * DAY - 1


@dataclass(frozen=True)
class TimeBase:
    """A calendar of `days` days from an anchor that is a Monday."""

    anchor: date
    days: int

    def __post_init__(self) -> None:
        if self.days < 1 or self.anchor.weekday() != 0:
            raise ConfigError("a time base has at least one day and starts on a Monday")

    @property
    def sim_end(self) -> int:
        return self.days * DAY

    def dates(self) -> list[date]:
        return [self.anchor + timedelta(days=d) for d in range(self.days)]

    def monthly_days(self, days_of_month: Iterable[int]) -> list[int]:
        """Numbers of the days that are one of days_of_month; in a short month its last day stands for later ones."""
        wanted, out = set(days_of_month), []
        for i, d in enumerate(self.dates()):
            last = ((d.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)).day
            if d.day in wanted or (d.day == last and any(w > last for w in wanted)):
                out.append(i)
        return out
