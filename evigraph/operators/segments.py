"""Ordered per-key computations that stay balanced when one key owns most of the rows.

A window over a hot key would put the whole key in one task. Here rows are first cut into
slices at quantiles of the order columns, so one (key, slice) group holds about one slice of
the table at most, and only one summary row per (key, slice) is combined along the key.

Null keys are a key like any other, null order values come first, as Spark sorts them, and the
result does not depend on the number of slices.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "_slice"


def _number(df: DataFrame, name: str) -> Column | None:
    """An order column as a number that rises with it; ``None`` for types without one."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    return F.col(name).cast("double") if isinstance(kind, (T.NumericType, T.BooleanType)) else None


def with_slices(df: DataFrame, order: list[str] | str, parts: int | None = None) -> DataFrame:
    """Add a slice number that rises with the order columns.

    ``parts`` defaults to the shuffle partition count, so a slice is about one partition. The
    cut points are quantiles of the first order column; a value that owns several of them, as
    coarse times do, is cut further at quantiles of the second column. Rows with a null in
    the first column form slice -1. Text columns are not cut, as they have no quantiles.
    """
    order = [order] if isinstance(order, str) else list(order)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = _number(df, order[0])
    if parts <= 1 or value is None:
        return df.withColumn(SLICE, F.lit(0).cast("long"))
    cuts = [i / parts for i in range(1, parts)]
    bounds = df.select(value.alias("v")).agg(
        F.percentile_approx("v", cuts, 10 * parts).alias("b")).first()["b"] or []
    if not bounds:                                          # no row has a value
        return df.withColumn(SLICE, F.lit(-1).cast("long"))
    splits = [float("-inf"), *sorted(set(bounds)), float("inf")]
    # Bucketizer searches the cut points by bisection, so many slices stay cheap.
    sliced = Bucketizer(splits=splits, inputCol="_value", outputCol="_bucket",
                        handleInvalid="keep").transform(df.withColumn("_value", value))
    within = F.lit(0)
    second = _number(df, order[1]) if len(order) > 1 else None
    heavy = {b: bounds.count(b) for b in set(bounds) if bounds.count(b) > 1}
    if heavy and second is not None:
        found = df.select(value.alias("v"), second.alias("w")).filter(F.col("v").isin(*heavy)) \
            .groupBy("v").agg(F.percentile_approx("w", cuts, 10 * parts).alias("b")).collect()
        cases = F.lit(parts)            # rows behind the heavy value in its bucket
        for r in found:
            steps = sorted(set(r["b"] or []))
            chosen = steps[::max(1, len(steps) // heavy[r["v"]])]
            rank = F.size(F.filter(F.array(*[F.lit(x) for x in chosen]), lambda x: x <= second)) \
                if chosen else F.lit(0)
            cases = F.when(F.col("_value") == r["v"], F.when(second.isNull(), F.lit(-1)).otherwise(rank)).otherwise(cases)
        within = cases
    number = F.col("_bucket").cast("long") * (parts + 2) + within + 1
    return sliced.withColumn(SLICE, F.coalesce(number, F.lit(-1).cast("long"))).drop("_value", "_bucket")


def _ordered(key: list[str], order: list[str], *more: str):
    return Window.partitionBy(*key, *more).orderBy(*order)


def join_nullsafe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which nulls are equal; the columns of ``on`` appear once."""
    names = {c: f"_right_{n}" for n, c in enumerate(on)}
    other = right.withColumnsRenamed(names)
    same = [left[c].eqNullSafe(other[n]) for c, n in names.items()]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return left.join(other, condition).drop(*names.values())


def previous_value(df: DataFrame, key: list[str], order: list[str], value: str,
                   name: str = "previous", parts: int | None = None) -> DataFrame:
    """The value of the row before, per key; NULL on the first row of a key."""
    rows = with_slices(df, order, parts)
    here = _ordered(key, order, SLICE)
    last = rows.groupBy(*key, SLICE).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    carry = last.select(
        *key, SLICE, F.lag("_last").over(Window.partitionBy(*key).orderBy(SLICE)).alias("_carry"))
    joined = join_nullsafe(rows.withColumn("_row", F.row_number().over(here))
                           .withColumn("_lag", F.lag(value).over(here)), carry, [*key, SLICE])
    return joined.withColumn(name, F.when(F.col("_row") == 1, F.col("_carry.v")).otherwise(F.col("_lag"))) \
        .drop("_row", "_lag", "_carry", SLICE)


def numbered(df: DataFrame, key: list[str], order: list[str], name: str = "number",
             parts: int | None = None) -> DataFrame:
    """1, 2, 3, … along each key."""
    rows = with_slices(df, order, parts)
    counts = rows.groupBy(*key, SLICE).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(
        Window.unboundedPreceding, -1)
    carry = counts.select(
        *key, SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = join_nullsafe(
        rows.withColumn("_row", F.row_number().over(_ordered(key, order, SLICE))), carry, [*key, SLICE])
    return joined.withColumn(name, F.col("_row") + F.col("_before")).drop("_row", "_before", SLICE)


def running_streak(df: DataFrame, key: list[str], order: list[str], breaks: Column,
                   name: str = "streak", parts: int | None = None) -> DataFrame:
    """Rows since the last one where ``breaks`` holds, per key; 0 on such a row."""
    broken = F.coalesce(breaks, F.lit(False)).cast("int")
    rows = with_slices(df.withColumn("_break", broken), order, parts)
    here = _ordered(key, order, SLICE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_island", F.sum("_break").over(here))
    rows = rows.withColumn(
        "_run", F.sum(1 - F.col("_break")).over(
            _ordered(key, order, SLICE, "_island").rowsBetween(
                Window.unboundedPreceding, Window.currentRow)))
    ends = rows.groupBy(*key, SLICE).agg(
        F.max("_break").alias("_broken"),
        F.max_by("_run", F.struct(*order)).alias("_tail"))
    along = Window.partitionBy(*key).orderBy(SLICE)
    ends = ends.withColumn("_group", F.sum("_broken").over(along))
    ends = ends.withColumn("_out", F.sum("_tail").over(
        Window.partitionBy(*key, "_group").orderBy(SLICE)))
    carry = ends.select(*key, SLICE, F.coalesce(F.lag("_out").over(along), F.lit(0)).alias("_in"))
    return (
        join_nullsafe(rows, carry, [*key, SLICE])
        .withColumn(name, F.col("_run") + F.when(F.col("_island") == 0, F.col("_in")).otherwise(0))
        .drop("_break", "_island", "_run", "_in", SLICE)
    )


def exact_median(df: DataFrame, by: list[str], value: str, name: str,
                 parts: int | None = None) -> DataFrame:
    """Exact median per group without holding a group in one task.

    Equal values are counted first, so ties cost one row. Slice counts locate the slices of
    the two middle ranks, and ranks are worked out inside those slices only.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count("*").alias("_n"))
    rows = with_slices(counted, value, parts)
    sliced = rows.groupBy(*by, SLICE).agg(F.sum("_n").alias("_s"))
    whole = Window.partitionBy(*by)
    along = whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sliced = (
        sliced.withColumn("_total", F.sum("_s").over(whole))
        .withColumn("_below", F.coalesce(F.sum("_s").over(along), F.lit(0)))
        .withColumn("_lo", F.floor((F.col("_total") + 1) / 2))
        .withColumn("_hi", F.floor((F.col("_total") + 2) / 2))
        .where((F.col("_below") < F.col("_hi")) & (F.col("_below") + F.col("_s") >= F.col("_lo")))
        .select(*by, SLICE, "_below", "_lo", "_hi")
    )
    inner = Window.partitionBy(*by, SLICE).orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = (
        join_nullsafe(rows, sliced, [*by, SLICE])
        .withColumn("_to", F.col("_below") + F.sum("_n").over(inner))
        .withColumn("_from", F.col("_to") - F.col("_n") + 1)
    )

    def at(rank):
        return F.max(F.when((F.col("_from") <= F.col(rank)) & (F.col(rank) <= F.col("_to")),
                            F.col(value)))
    return ranked.groupBy(*by).agg(((at("_lo") + at("_hi")) / 2).alias(name))
