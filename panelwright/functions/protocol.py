"""The time protocol: a warm-up period, an evaluation period, and walk-forward splits; all bounds are inclusive ISO dates."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import column, strip


@dataclass(frozen=True)
class Window:
    warmup_start: str = "2015-09-01"
    warmup_end: str = "2015-12-31"
    evaluation_start: str = "2016-01-01"
    evaluation_end: str = "2023-12-31"

    def __post_init__(self) -> None:
        days = [date.fromisoformat(x) for x in (self.warmup_start, self.warmup_end, self.evaluation_start, self.evaluation_end)]
        if days != sorted(days) or days[1] == days[2]:
            raise ValueError("warm-up and evaluation must follow one another")


def window_from(config: dict) -> Window:
    """A window of a mapping {warmup: {start, end}, evaluation: {start, end}}."""
    if not isinstance(config, dict):
        raise TypeError("the protocol must be a mapping")
    return Window(*(str(config[part][end]) for part in ("warmup", "evaluation") for end in ("start", "end")))


def walk_forward(window: Window, train: int = 3, validation: int = 1, test: int = 1) -> list[tuple[str, str, str, str]]:
    """(split, partition, start, end): every run of train, validation and test years within the evaluation, moved by a year."""
    first, last = int(window.evaluation_start[:4]), int(window.evaluation_end[:4])
    out = []
    for k, year in enumerate(range(first, last - train - validation - test + 2), 1):
        at = year
        for name, years in (("train", train), ("val", validation), ("test", test)):
            out.append((f"S{k}", name, f"{at}-01-01", f"{at + years - 1}-12-31"))
            at += years
    return out


def splits_frame(spark: SparkSession, splits: list[tuple[str, str, str, str]], only: set[str] | None = None) -> DataFrame:
    return spark.createDataFrame([s for s in splits if not only or s[0] in only], "split string, partition string, split_start string, split_end string")


def timestamp_utc(c: Column | str) -> Column:
    """A time in UTC; null where the text is none. A trailing zone name is understood."""
    return F.try_to_timestamp(strip(column(c)))


def iso_date(c: Column | str) -> Column:
    return F.date_format(column(c), "yyyy-MM-dd")


def day(c: Column | str) -> Column:
    """The date of an ISO text or a time; null where there is none."""
    return column(c).try_cast("date")


def _between(c: Column | str, low: str, high: str) -> Column:
    return F.coalesce(day(c).between(F.lit(low).cast("date"), F.lit(high).cast("date")), F.lit(False))


def in_protocol(c: Column | str, w: Window) -> Column:
    return _between(c, w.warmup_start, w.evaluation_end)


def is_warmup(c: Column | str, w: Window) -> Column:
    return _between(c, w.warmup_start, w.warmup_end)


def in_evaluation(c: Column | str, w: Window) -> Column:
    return _between(c, w.evaluation_start, w.evaluation_end)


RELATIONS = {"<": operator.lt, "<=": operator.le, "==": operator.eq, ">=": operator.ge, ">": operator.gt}


def compare(left: Column, right: Column, relation: str) -> Column:
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation!r}")
    return RELATIONS[relation](left, right)


def true(c: Column | str) -> Column:
    """True only where c is; null is false."""
    return F.coalesce(column(c).cast("boolean"), F.lit(False))


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """shard_id (yyyy-MM), start and end of each month that the period touches, cut to the period's end."""
    first = F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.trunc(F.lit(end).cast("date"), "MM"), F.expr("interval 1 month")))
    return spark.range(1).select(first.alias("m")).select(F.date_format("m", "yyyy-MM").alias("shard_id"), F.date_format("m", "yyyy-MM-dd").alias("start"), F.date_format(F.least(F.last_day("m"), F.lit(end).cast("date")), "yyyy-MM-dd").alias("end"))


def names(text: str | None) -> set[str] | None:
    """A comma-separated filter as a set of upper-case names; None if it names nothing."""
    found = {x.strip().upper() for x in (text or "").split(",") if x.strip()}
    return found or None


def cutoff_of(text: str | None, window: Window) -> str:
    """The given cutoff date, or the end of the evaluation."""
    return date.fromisoformat(text.strip()).isoformat() if text and text.strip() else window.evaluation_end
