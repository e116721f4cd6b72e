"""Neighbours and running sums along an ordering column, without putting a long curve into one task.

The ordering column is cut at `segments` - 1 quantiles, the same for all groups. Windows run within (group, segment); what
crosses a cut comes from a small table with one row for each group and segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import quoted as q

SEGMENT = "_segment"


def segmented(df: DataFrame, x: str, segments: int) -> DataFrame:
    if segments <= 1:
        return df.withColumn(SEGMENT, F.lit(0))
    cuts = df.agg(F.percentile_approx(q(x), [i / segments for i in range(1, segments)], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    return df.withColumn(SEGMENT, F.size(F.filter(cuts, lambda c: c <= F.col(q(x)))))


def with_previous(df: DataFrame, groups: list[str], x: str, columns: list[str], segments: int = 1) -> DataFrame:
    """df with _prev, a struct of the columns in the row before (null in each group's first)."""
    row = F.struct(*[F.col(q(c)).alias(c) for c in columns])
    cut = segmented(df, x, segments)
    keys = [q(g) for g in groups]
    out = cut.withColumn("_prev", F.lag(row).over(Window.partitionBy(*keys, SEGMENT).orderBy(q(x))))
    if segments <= 1:
        return out.drop(SEGMENT)
    ends = cut.groupBy(*keys, SEGMENT).agg(F.max_by(row, q(x)).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy(SEGMENT))).drop("_end")
    if not keys:
        out = out.join(F.broadcast(ends), SEGMENT, "left")  # at most `segments` rows
    else:
        out = out.join(ends, [*groups, SEGMENT], "left")
    return out.withColumn("_prev", F.coalesce("_prev", "_before")).drop("_before", SEGMENT)


def running_sum(df: DataFrame, groups: list[str], x: str, column: str, to: str, segments: int = 1) -> DataFrame:
    """df with the sum of the column up to each row."""
    keys = [q(g) for g in groups]
    cut = segmented(df, x, segments)
    out = cut.withColumn(to, F.sum(q(column)).over(Window.partitionBy(*keys, SEGMENT).orderBy(q(x)).rowsBetween(Window.unboundedPreceding, 0)))
    if segments <= 1:
        return out.drop(SEGMENT)
    sums = cut.groupBy(*keys, SEGMENT).agg(F.sum(q(column)).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", before).drop("_sum")
    out = out.join(F.broadcast(sums), SEGMENT, "left") if not keys else out.join(sums, [*groups, SEGMENT], "left")
    return out.withColumn(to, F.col(q(to)) + F.coalesce("_before", F.lit(0.0))).drop("_before", SEGMENT)
