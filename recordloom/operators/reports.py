"""Control-break reports as roll-ups, and their lines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.ordering import numbered


@dataclass
class Report:
    """controls, major first; sums: output name to source column; page: detail lines a page."""

    controls: list[str]
    sums: dict[str, str]
    page: int = 0
    details: list[tuple[int, Column]] = field(default_factory=list)


def footings(df: DataFrame, report: Report) -> DataFrame:
    """Totals of every control level and FINAL: one ROLLUP; break_level counts the controls that are kept (0: FINAL)."""
    out = df.rollup(*report.controls).agg(*[F.sum(c).alias(n) for n, c in report.sums.items()], F.count("*").alias("n_details"), F.grouping_id().alias("_g"))
    size = len(report.controls)
    level = F.lit(size) - F.bit_count("_g") if size else F.lit(0)
    return out.select(*report.controls, *report.sums, "n_details", level.cast("int").alias("break_level"))


def breaks(df: DataFrame, report: Report, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """Details with the highest control that changed before them (0: none), page and line; within `partition`, if given.

    Without a partition places come from ranges of the order, and a row's predecessor from a join on its place, so
    no task holds all details.
    """
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order)
        out = df.withColumn("_rn", F.row_number().over(w))
        before = [F.lag(c).over(w) for c in report.controls]
    else:
        out = numbered(df, [F.col(c).asc() for c in order], "_rn")
        out = out.join(out.select((F.col("_rn") + 1).alias("_rn"), *[F.col(c).alias(f"_before_{i}") for i, c in enumerate(report.controls)]), "_rn", "left")
        before = [F.col(f"_before_{i}") for i in range(len(report.controls))]
    level = F.lit(0)
    for i in reversed(range(len(report.controls))):
        level = F.when((F.col("_rn") == 1) | ~before[i].eqNullSafe(F.col(report.controls[i])), i + 1).otherwise(level)
    out = out.withColumn("break_control", level)
    if report.page:
        out = out.withColumn("page", F.floor((F.col("_rn") - 1) / report.page).cast("int") + 1).withColumn("line", ((F.col("_rn") - 1) % report.page).cast("int") + 1)
    return out.drop("_rn", *[f"_before_{i}" for i in range(len(report.controls))])


def line(columns: list[tuple[int, Column]], width: int) -> Column:
    """A print line: each value from its column (from 1) on."""
    out = F.repeat(F.lit(" "), F.lit(width))
    for at, value in columns:
        out = F.overlay(out, value, F.lit(at))
    return F.rtrim(out.substr(1, width))


def indicate(value: Column, control: str = "break_control", line: str | None = None) -> Column:
    """GROUP INDICATE over what `breaks` gives: the value on the first line after a break, or of a page if `line` is named; else blank."""
    first = F.col(control) > 0
    if line is not None:
        first = first | (F.col(line) == 1)
    return F.when(first, value.cast("string")).otherwise("")
