"""Guards against looking ahead. Each table is checked by one aggregate over all its rules; empty tables pass."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.protocol import compare, day


class LeakageError(ValueError):
    """A table has rows that see beyond their cutoff, or dates that cannot be told."""


@dataclass(frozen=True)
class Rule:
    """A rule by name; broken is true for the rows that break it and null where a date is missing."""

    name: str
    broken: Column


def cutoff(value: str | date | datetime) -> str:
    """A cutoff as ISO date."""
    if isinstance(value, datetime):
        value = value.date()
    return value.isoformat() if isinstance(value, date) else date.fromisoformat(str(value)[:10]).isoformat()


def not_after(column: str, limit: str, allow_equal: bool = True) -> Rule:
    bound = F.lit(cutoff(limit)).cast("date")
    return Rule(f"{column} after {limit}", day(column) > bound if allow_equal else day(column) >= bound)


def not_before(column: str, limit: str) -> Rule:
    return Rule(f"{column} before {limit}", day(column) < F.lit(cutoff(limit)).cast("date"))


def relation(left: str, right: str, how: str) -> Rule:
    return Rule(f"not {left} {how} {right}", ~compare(day(left), day(right), how))


def counts(frame: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row: for each rule (r0, r1, ...) the number of rows that break it or lack one of its dates."""
    return frame.agg(*[F.coalesce(F.sum(F.when(F.coalesce(r.broken, F.lit(True)), 1).otherwise(0)), F.lit(0)).cast("long").alias(f"r{i}") for i, r in enumerate(rules)])


def check(frame: DataFrame, rules: list[Rule], context: str = "table") -> DataFrame:
    """frame itself, if no row breaks a rule; else LeakageError with up to three rows of the first rule broken."""
    found = counts(frame, rules).first()
    for r, n in zip(rules, found, strict=True):
        if n:
            rows = frame.where(F.coalesce(r.broken, F.lit(True))).limit(3).collect()
            raise LeakageError(f"{context}: {r.name} in {n} rows, as {[row.asDict() for row in rows]}")
    return frame


def guarded(frame: DataFrame, rules: list[Rule], context: str, column: str) -> DataFrame:
    """frame with the rules in its plan: reading `column` of a row that breaks one raises, so name one that every reader needs. There is no
    extra pass. The test is a projection and not a filter, which Spark would move below joins, to rows that are not in frame."""
    bad = F.coalesce(*[F.when(F.coalesce(r.broken, F.lit(True)), F.raise_error(F.lit(f"{context}: {r.name}")).cast("boolean")) for r in rules], F.lit(True))
    return frame.withColumn(column, F.when(bad, F.col(column)))


def up_to(frame: DataFrame, column: str, limit: str, allow_equal: bool = True, context: str = "table") -> DataFrame:
    """The rows up to the cutoff; dates that cannot be told raise."""
    check(frame, [Rule(f"{column} is no date", F.when(day(column).isNull(), F.lit(True)).otherwise(F.lit(False)))], context)
    bound = F.lit(cutoff(limit)).cast("date")
    return frame.where(day(column) <= bound if allow_equal else day(column) < bound)


def feature_rules(limit: str) -> list[Rule]:
    return [not_after("as_of_date", limit), relation("feature_window_end_date", "as_of_date", "==")]


def label_rules(limit: str) -> list[Rule]:
    return [not_after("as_of_date", limit), not_after("label_end_date", limit), relation("as_of_date", "label_start_date", "<"), relation("label_start_date", "label_end_date", "<=")]


def sample_rules(limit: str, evaluation_start: str) -> list[Rule]:
    return [not_before("as_of_date", evaluation_start), not_after("as_of_date", limit), relation("as_of_date", "cutoff_date", "=="), relation("as_of_date", "label_start_date", "<"), relation("label_start_date", "label_end_date", "<=")]
