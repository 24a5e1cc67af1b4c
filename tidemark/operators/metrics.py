"""Report operators: nearest-rank summaries, bucket quantiles, guarded ratios and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets in seconds; the last bucket has no bound.
BOUNDS = [0.00025, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def percent_change(base: Column, now: Column) -> Column:
    return F.when(base == 0, F.lit(0.0)).otherwise((now - base) / base * 100.0)


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column], shift: int = 20) -> DataFrame:
    """{name: value at a rank} per key; a rank is a column of ``n``, the key's rows, and counts from 0.

    Two levels, so that no window holds all distinct values of a key: counts of the high bits find the cell of 2^shift
    values in which each rank lies, and only the values of those cells are ordered.  ``value`` is an integer; nulls
    are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c")).withColumn("__high", F.shiftright("__v", shift))
    cells = counts.groupBy(*by, "__high").agg(F.sum("__c").alias("__h"))
    upto = F.sum("__h").over(Window.partitionBy(*by).orderBy("__high").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumns({"__upto": upto, "n": F.sum("__h").over(Window.partitionBy(*by))})
    wanted = cells.withColumn("__r", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()))))
    before = F.col("__upto") - F.col("__h")
    wanted = wanted.where((F.col("__upto") > F.col("__r.rank")) & (before <= F.col("__r.rank"))).select(*by, "__high", F.col("__r.name").alias("__name"), (F.col("__r.rank") - before).alias("__left"))
    inside = counts.join(wanted, [*by, "__high"])
    own = F.sum("__c").over(Window.partitionBy(*by, "__name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("__own", own).where("__own > __left").groupBy(*by, "__name").agg(F.min("__v").alias("__v"))
    return found.groupBy(*by).agg(*(F.min(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks))


def nearest_rank(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """{name: quantile} as the value of rank ceil((n - 1) q) from 0, exactly."""
    return at_ranks(df, by, value, {name: F.ceil((F.col("n") - 1) * F.lit(q)) for name, q in quantiles.items()})


def upper_median(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """sorted[n div 2]: never an average of two."""
    return at_ranks(df, by, value, {name: F.floor(F.col("n") / 2)})


def counter_delta(before: Column, after: Column) -> Column:
    """What a counter grew by; one that began anew makes it 0, not negative."""
    return F.greatest(after - before, F.lit(0))


def cumulative_buckets(df: DataFrame, by: list[str], seconds: Column, bounds: list[float] = BOUNDS) -> DataFrame:
    """Cumulative counts per bound (``le``), and all under +Inf (null): one pass of conditional counts, then unpivoted."""
    cells = F.array(*(F.struct(F.lit(b).alias("le"), F.count_if(seconds <= b).alias("cumulative")) for b in bounds), F.struct(F.lit(None).cast("double").alias("le"), F.count("*").alias("cumulative")))
    return df.groupBy(*by).agg(cells.alias("b")).withColumn("b", F.explode("b")).select(*by, "b.le", "b.cumulative")


def bucket_quantile(histogram: DataFrame, by: list[str], quantiles: list[float]) -> DataFrame:
    """The first bound whose cumulative count reaches total * q; over all bounds it is ``>300 s``, of nothing ``n/a``."""
    order = F.coalesce(F.col("le"), F.lit(float("inf")))
    total = histogram.groupBy(*by).agg(F.max_by("cumulative", order).alias("total"))
    rows = histogram.join(total, by).withColumn("quantile", F.explode(F.array(*map(F.lit, quantiles))))
    reached = rows.where(F.col("cumulative") >= F.col("total") * F.col("quantile"))
    first = reached.groupBy(*by, "quantile", "total").agg(F.min(order).alias("le"))
    return first.withColumn("upper_bound", F.when(F.col("total") == 0, "n/a").when(F.col("le") == float("inf"), ">300 s").otherwise(duration_text(F.col("le"))))


def duration_text(seconds: Column) -> Column:
    """``≤1.000 ms`` below a second, ``≤1.000 s`` from there."""
    return F.when(seconds < 1, F.format_string("≤%.3f ms", seconds * 1000)).otherwise(F.format_string("≤%.3f s", seconds))


def escape_label(value: Column) -> Column:
    """Backslash, line end and quote, in this order."""
    slash = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(slash, F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
