"""Running sums and row numbers over a whole group, without a task that holds one.

A group is cut into BINS ranges of its order; sums of ranges are small and come first, and only the rows of one range are
ordered together.  Ranges come from approximate quantiles of the group's own values; they decide where the work is done,
never what it gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 64


def same(keys: list[str], prefix: str = "_") -> Column:
    """Keys equal to their prefixed copies; nulls are equal."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys], F.lit(True))


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_{k}" for k in keys})


def binned(df: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """Adds _bin: ranges of ``value`` within each group, about equally many rows in each."""
    quantiles = F.percentile_approx(value, F.array(*[F.lit(i / bins) for i in range(1, bins)]), F.lit(2000))
    cuts = _renamed(df.groupBy(*keys).agg(quantiles.alias("_cuts")), keys)
    found = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))
    return df.join(cuts, same(keys)).withColumn("_bin", found).drop("_cuts", *[f"_{k}" for k in keys])


def running(df: DataFrame, keys: list[str], value: str, columns: list[str], bins: int = BINS) -> DataFrame:
    """For each of ``columns`` its sum over the rows of smaller ``value`` (below_*) and over the group (all_*).

    Values must be distinct within a group.
    """
    rows = binned(df, keys, value, bins)
    sums = rows.groupBy(*keys, "_bin").agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns])
    by_bin, group = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    ahead = sums.select(*keys, "_bin", *[F.coalesce(F.sum(f"_sum_{c}").over(by_bin), F.lit(0.0)).alias(f"_ahead_{c}") for c in columns], *[F.sum(f"_sum_{c}").over(group).alias(f"all_{c}") for c in columns])
    inner = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(inner), F.lit(0.0)) for c in columns})
    out = rows.join(_renamed(ahead, [*keys, "_bin"]), same([*keys, "_bin"]))
    out = out.withColumns({f"below_{c}": F.col(f"_ahead_{c}") + F.col(f"_in_{c}") for c in columns})
    return out.select(*df.columns, *[f"below_{c}" for c in columns], *[f"all_{c}" for c in columns])


def numbered(df: DataFrame, keys: list[str], bin_of: Column, order: list[Column | str], name: str = "row_number") -> DataFrame:
    """Adds 1, 2, ... in the order of (bin_of, *order) within each group; bin_of must not disagree with the order."""
    rows = df.withColumn("_bin", bin_of)
    counts = rows.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*keys, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inner = Window.partitionBy(*keys, "_bin").orderBy(*order)
    out = rows.withColumn("_at", F.row_number().over(inner)).join(_renamed(first, [*keys, "_bin"]), same([*keys, "_bin"]))
    return out.select(*df.columns, (F.col("_first") + F.col("_at")).alias(name))


def numbered_by(df: DataFrame, value: str, ties: list[Column | str], name: str = "row_number") -> DataFrame:
    """Row numbers of a whole table by a numeric column, then ``ties``."""
    rows = df.withColumn("_all", F.lit(0))
    placed = binned(rows, ["_all"], value)
    out = numbered(placed.withColumnRenamed("_bin", "_range"), ["_all"], F.col("_range"), [value, *ties], name)
    return out.select(*df.columns, name)
