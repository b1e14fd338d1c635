"""As-of joins, exact joins with forward fill, interval sums and point-in-time universes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str]) -> DataFrame:
    """Each left row with the whole last right row at or before it, nulls in that row included.

    Both sides are united and one window carries the last right row forward: one shuffle on `by`, no inequality
    join. right has at most one row for each (by, on)."""
    values = [c for c in right.columns if c not in (*by, on)]
    tagged = right.select(*by, on, F.struct(*values).alias("_r"), F.lit(0).alias("_side"))
    for c in left.columns:
        if c not in (*by, on):
            tagged = tagged.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    probes = left.withColumn("_r", F.lit(None).cast(tagged.schema["_r"].dataType)).withColumn("_side", F.lit(1))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = tagged.unionByName(probes).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def exact_join_ffill(left: DataFrame, right: DataFrame, columns: list[str], by: list[str], on: str = "date") -> DataFrame:
    """Left join on the very date, then each column carried forward by itself: right rows on dates that left does
    not have are lost, null cells are skipped."""
    w = Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    joined = left.join(right.select(*by, on, *columns), [*by, on], "left")
    return joined.select(*left.columns, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns])


def outer_align(series: list[DataFrame], on: str, by: list[str] | None = None) -> DataFrame:
    """All series on all dates of any of them, carried forward, for each key of `by`."""
    keys = [*(by or []), on]
    joined = reduce(lambda a, b: a.join(b, keys, "full_outer"), series)
    w = Window.partitionBy(*(by or [])).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)  # without keys one macro calendar: a row a day
    return joined.select(*keys, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in joined.columns if c not in keys])


def term_structure(df: DataFrame) -> DataFrame:
    ratio = F.col("vix_close") / F.nullif(F.col("vix_3m"), F.lit(0.0))
    return df.withColumn("vix_ratio", ratio).withColumn("vix_regime", F.when(F.col("vix_ratio") < 1, "contango").when(F.col("vix_ratio") >= 1, "backwardation"))


def interval_sums(days: DataFrame, daily: DataFrame, wanted: dict[str, tuple[str, int]], on: str, at: str, by: list[str] | None = None) -> DataFrame:
    """For each day, sums of daily columns over the calendar days [day - n, day]; 0 where there are none.

    daily has one row a day (and by); days and daily are united and summed by range windows."""
    by = by or []
    cols = sorted({c for c, _ in wanted.values()})
    left = days.select(*by, F.col(on).alias("_d"), *[F.lit(None).cast("double").alias(c) for c in cols], F.lit(True).alias("_probe"))
    right = daily.select(*by, F.col(at).alias("_d"), *[F.col(c).cast("double").alias(c) for c in cols], F.lit(False).alias("_probe"))
    both = left.unionAll(right).withColumn("_n", F.unix_date("_d"))

    def over(c: str, n: int) -> Column:
        return F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy("_n").rangeBetween(-n, 0)), F.lit(0.0))

    out = both.withColumns({name: over(c, n) for name, (c, n) in wanted.items()}).where("_probe")
    return out.select(*by, F.col("_d").alias(on), *wanted)


def universe_filter(rows: DataFrame, members: DataFrame, snaps: DataFrame) -> DataFrame:
    """Rows whose symbol is in the latest snapshot at their date; all rows before the first snapshot."""
    first = rows.select("date").distinct().withColumn("_all", F.lit(0))
    known = asof_join(first, snaps.select(F.col("snap").alias("date"), F.lit(0).alias("_all"), "snap"), on="date", by=["_all"]).drop("_all")
    dated = rows.join(known, "date")
    named = dated.where("snap is not null").join(members, ["snap", "symbol"], "left_semi")
    return named.select(*rows.columns).unionByName(dated.where("snap is null").select(*rows.columns))
