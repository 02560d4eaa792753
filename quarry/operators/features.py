"""Features in long form: choice and parsing of names, unpivoting, NaN policies, guards."""

from __future__ import annotations

import re
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import ranks

METRICS = ("HFER", "Fiedler", "Smoothness", "Entropy")


def pick(columns: list[str], rule: str = "metric", metric: str | None = None, without: tuple[str, ...] = ()) -> list[str]:
    """Feature columns by name: ``metric`` L* with a known metric, ``layer_`` L*_*, ``layer`` L*, ``all`` but ``without``, ``one`` metric by layer."""
    if rule == "metric":
        return [c for c in columns if c.startswith("L") and any(m in c for m in METRICS)]
    if rule == "layer_":
        return [c for c in columns if c.startswith("L") and "_" in c]
    if rule == "layer":
        return [c for c in columns if c.startswith("L")]
    if rule == "one":
        return sorted((c for c in columns if metric in c), key=lambda c: int(re.match(r"L(\d+)", c)[1]))
    return [c for c in columns if c not in without]


def unpivot(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """ids, feature, value; + 0.0 makes a negative zero a zero, so that they tie."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(ids, features, "feature", "value").withColumn("value", F.col("value") + F.lit(0.0))


def parsed(df: DataFrame) -> DataFrame:
    """layer and metric of names like L12_Entropy; null and '' for other names."""
    name = r"^L(\d+)_(\w+)$"
    return df.withColumns({"layer": F.expr(f"try_cast(regexp_extract(feature, r'{name}', 1) as int)"), "metric": F.regexp_extract("feature", name, 2)})


def clean(df: DataFrame, policy: str, column: str = "value") -> DataFrame:
    """``zero_inf``: NaN and null to 0, infinities to the largest double; ``zero``: NaN and null to 0; ``drop``; ``none``."""
    c = F.col(column)
    if policy == "zero_inf":
        top = sys.float_info.max
        return df.withColumn(column, F.when(c.isNull() | F.isnan(c), F.lit(0.0)).when(c == float("inf"), F.lit(top)).when(c == float("-inf"), F.lit(-top)).otherwise(c))
    if policy == "zero":
        return df.withColumn(column, F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)))
    return df.where(c.isNotNull() & ~F.isnan(c)) if policy == "drop" else df


def enough(df: DataFrame, keys: list[str], rows: int = 0, positives: int = 2, negatives: int = 2) -> DataFrame:
    """Groups with enough rows of each class; classes are counted first, with map-side combination."""
    n, p = F.count("*"), F.sum("y")
    good = df.groupBy(*keys).agg(n.alias("_n"), p.alias("_p")).where((F.col("_n") >= rows) & (F.col("_p") >= positives) & (F.col("_n") - F.col("_p") >= negatives))
    good = good.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return df.join(good, ranks.same(keys), "left_semi")


def negated(df: DataFrame, features: list[str]) -> DataFrame:
    """The long table with the values of some features negated."""
    return df.withColumn("value", F.when(F.col("feature").isin(features), -F.col("value")).otherwise(F.col("value")))


def standardized(df: DataFrame, keys: list[str]) -> DataFrame:
    """(x - mean) / population deviation, 0 where that is 0; statistics are aggregated and joined, not windowed."""
    stats = df.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return df.join(stats, keys).withColumn("z", F.coalesce(F.try_divide(F.col("value") - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s")
