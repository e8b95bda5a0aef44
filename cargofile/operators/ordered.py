"""Ordered computations that do not put a whole filing into one task.

A plain ``Window.partitionBy(filing)`` sorts each filing inside a single task, which is
fine until one filing holds a large share of the data.  The helpers here cut every group
into slices of consecutive order values, work inside the slices, reduce each slice to one
row, run the window over those summary rows only, and join the carried value back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cargofile.sources.shared import cut

SLICE_ROWS = 1 << 16


def with_slice(df: DataFrame, by: list[str], order: str, rows: int = SLICE_ROWS, dense: bool = False) -> DataFrame:
    """Add ``_slice``: consecutive runs of at most about ``rows`` rows along ``order`` in each group.

    ``dense`` means the order column counts 1, 2, 3 … inside the group (line numbers), so
    the slice is plain arithmetic.  Otherwise a range that holds over ``rows`` rows is cut into equal
    value ranges by its own smallest and largest value, and those over twice ``rows`` again, until
    none is left: an outlier or a dense cluster costs one more pass, not a task.  The list of ranges to
    cut has a row per ``rows`` rows of large groups at most, and usually none.
    """
    if dense:
        return df.withColumn("_slice", F.struct(F.floor((F.col(order) - 1) / rows).cast("long").alias("_0")))
    names = ["_0"]
    df = df.withColumn("_0", F.shiftright(F.col(order).cast("long"), 62))
    while True:
        key = by + names
        span = cut(df.groupBy(*key).agg(
            F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.count(F.lit(1)).alias("_n")
        ).filter((F.col("_n") > (rows if len(names) == 1 else 2 * rows)) & (F.col("_lo") < F.col("_hi"))).select(
            *key, "_lo", F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_n") / rows)).alias("_width")))
        if span.isEmpty():
            return df.withColumn("_slice", F.struct(*names)).drop(*names)
        place = F.floor((F.col(order) - F.col("_lo")) / F.col("_width")).cast("long")
        name = f"_{len(names)}"
        df = df.join(span, key, "left").withColumn(name, F.coalesce(place, F.lit(0))).drop("_lo", "_width")
        names.append(name)


def running_total(df: DataFrame, by: list[str], order: str, amount: Column, out: str,
                  rows: int = SLICE_ROWS, dense: bool = False) -> DataFrame:
    """Inclusive running sum of ``amount`` along ``order`` inside each group."""
    part = by + ["_slice"]
    cut = with_slice(df, by, order, rows, dense).withColumn("_amt", amount.cast("long"))
    inner = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        cut.groupBy(*part).agg(F.sum("_amt").alias("_sum"))
        .select(*part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    )
    return (
        cut.withColumn("_run", F.sum("_amt").over(inner))
        .join(carry, part)
        .withColumn(out, F.col("_run") + F.col("_carry"))
        .drop("_slice", "_amt", "_run", "_carry")
    )


def carry_last(df: DataFrame, by: list[str], order: str, value: Column, out: str,
               rows: int = SLICE_ROWS, dense: bool = True) -> DataFrame:
    """Last non-null ``value`` at or before each row along ``order`` inside each group."""
    part = by + ["_slice"]
    cut = with_slice(df, by, order, rows, dense).withColumn("_val", value)
    inner = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        cut.groupBy(*part).agg(F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col(order))).alias("_end"))
        .select(*part, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    )
    return (
        cut.withColumn("_own", F.last("_val", ignorenulls=True).over(inner))
        .join(carry, part)
        .withColumn(out, F.coalesce("_own", "_carry"))
        .drop("_slice", "_val", "_own", "_carry")
    )


def number_rows(df: DataFrame, by: list[str], order: str, out: str, rows: int = SLICE_ROWS) -> DataFrame:
    """1-based position along ``order`` inside each group (order values are unique)."""
    return running_total(df, by, order, F.lit(1), out, rows)


def top_n(df: DataFrame, by: list[str], order: list, n: int, pos: str) -> DataFrame:
    """First ``n`` rows of each group.  ``row_number() <= n`` is cut per map task first
    (WindowGroupLimit), so a hot group ships at most ``n`` rows per task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(pos, F.row_number().over(w)).filter(F.col(pos) <= n)
