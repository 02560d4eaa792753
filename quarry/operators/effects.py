"""Class profiles, effect sizes and significance; one conditional aggregate serves each group."""

from __future__ import annotations

import math
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.operators import curves, ranks


def _of(label: int):
    return F.when(F.col("y") == label, F.col("value"))


def profile(df: DataFrame, keys: list[str], ddof: int = 0) -> DataFrame:
    """Mean and deviation of either class, and the bands mean +- deviation."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    out = df.groupBy(*keys).agg(*[f.alias(f"{n}_{s}") for n, k in (("v", 0), ("i", 1)) for s, f in (("mean", F.avg(_of(k))), ("std", std(_of(k))))])
    return out.withColumns({f"{n}_{s}": F.col(f"{n}_mean") + sign * F.col(f"{n}_std") for n in "vi" for s, sign in (("upper", 1), ("lower", -1))})


def class_means(df: DataFrame, keys: list[str]) -> DataFrame:
    """v_mean and i_mean, 0 for an empty class, and the medians, null for one."""
    filled = lambda k: F.coalesce(F.avg(_of(k)), F.lit(0.0))
    return df.groupBy(*keys).agg(filled(0).alias("v_mean"), filled(1).alias("i_mean"), F.median(_of(0)).alias("v_median"), F.median(_of(1)).alias("i_median"))


def moments(df: DataFrame, keys: list[str]) -> DataFrame:
    parts = [f.alias(f"{s}{k}") for k in (0, 1) for s, f in (("n", F.count(_of(k)).cast("double")), ("m", F.avg(_of(k))), ("v", F.var_samp(_of(k))))]
    return df.groupBy(*keys).agg(*parts)


def cohens_d(df: DataFrame, keys: list[str], absolute: bool = False, guarded: bool = True) -> DataFrame:
    """(mean1 - mean0) / pooled deviation, ddof 1; 0 for no deviation or an empty class if guarded, else null."""
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), F.col("n1") + F.col("n0") - 2))
    d = F.try_divide(F.col("m1") - F.col("m0"), pooled)
    d = F.coalesce(d, F.lit(0.0)) if guarded else d
    return moments(df, keys).select(*keys, (F.abs(d) if absolute else d).alias("d"))


@F.pandas_udf(T.DoubleType())
def normal_tails(z: pd.Series) -> pd.Series:
    """The two tails of the normal distribution beyond |z|."""
    return z.map(lambda x: None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)))


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def student_tails(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if not (a == a and b == b) else _beta(b / 2, 0.5, b / (b + a * a)) for a, b in zip(t.astype(float), df.astype(float), strict=True)])


def mann_whitney(df: DataFrame, keys: list[str], p: bool = False) -> DataFrame:
    """U of class 1 and its tie-corrected z with continuity correction; with ``p`` the two-sided normal p, 1 if undefined."""
    t = F.col("p") + F.col("n")
    rows = curves.cumulative(df, keys).withColumns({"won": F.col("p") * (F.col("below_n") + F.col("n") / 2), "ties": t * t * t - t})
    g = rows.groupBy(*keys).agg(F.sum("won").alias("u"), F.sum("p").alias("n1"), F.sum("n").alias("n0"), F.sum("ties").alias("ties"))
    n = F.col("n1") + F.col("n0")
    sigma = F.sqrt(F.col("n1") * F.col("n0") / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    gap = F.abs(F.col("u") - F.col("n1") * F.col("n0") / 2)
    out = g.withColumn("z", F.try_divide(F.greatest(gap - 0.5, F.lit(0.0)), sigma)).select(*keys, "u", "z")
    return out.withColumn("p", F.coalesce(normal_tails("z"), F.lit(1.0))) if p else out


def welch(df: DataFrame, keys: list[str], p: bool = False) -> DataFrame:
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    free = F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))
    out = moments(df, keys).where("n1 > 1 and n0 > 1").select(*keys, F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b)).alias("t"), free.alias("df"))
    return out.withColumn("p", student_tails("t", "df")) if p else out


def benjamini_hochberg(df: DataFrame, family: list[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Adjusted p within each family, and whether it is below alpha."""
    up = Window.partitionBy(*family).orderBy(p)
    m = F.count("*").over(Window.partitionBy(*family))
    ranked = df.withColumn("_raw", F.col(p) * m / F.row_number().over(up))
    down = Window.partitionBy(*family).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min("_raw").over(down))
    return ranked.withColumn("p_adjusted", adjusted).withColumn("significant", F.col("p_adjusted") < alpha).drop("_raw")


def bootstrap_auc(df: DataFrame, keys: list[str], draws: int = 1000, alpha: float = 0.05, seed: int = 42, rule: str = "interpolated", fallback: tuple[float, float] | None = None) -> DataFrame:
    """lo and hi of the area over resamples; ``index`` picks sorted[int(alpha / 2 * n)], one-class draws are left out.

    A row's multiplicity in a draw is Poisson(1), so a distinct score of p positives and n negatives stands for Poisson(p)
    and Poisson(n) rows: draws are made for distinct scores, in ranges of them, by a generator seeded with the range and
    ``seed``, the same on any partitioning.  A range gives each draw's rows and wins within it; those across ranges follow
    from sums.  ``fallback`` stands for groups without a draw of two classes.
    """
    import numpy as np

    scores = ranks.binned(curves.by_score(df, keys).where("value is not null"), keys, "value")

    def resampled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        p, n = pdf["p"].to_numpy(), pdf["n"].to_numpy()
        rng = np.random.default_rng([seed, int(pdf["_bin"].iloc[0]), zlib.crc32(repr([pdf[k].iloc[0] for k in keys]).encode())])
        got = []
        for at in range(0, draws, 50):
            a, b = (rng.poisson(x, (min(50, draws - at), len(x))).astype(float) for x in (p, n))
            got.append((a.sum(axis=1), b.sum(axis=1), (a * (np.cumsum(b, axis=1) - b / 2)).sum(axis=1)))
        a, b, won = (np.concatenate(x) for x in zip(*got, strict=True))
        head = {k: [pdf[k].iloc[0]] * draws for k in keys}
        return pd.DataFrame({**head, "_bin": pdf["_bin"].iloc[0], "draw": np.arange(draws), "a": a, "b": b, "won": won})

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scores.select(*keys).schema.fields)
    parts = scores.groupBy(*keys, "_bin").applyInPandas(resampled, f"{named}, _bin int, draw int, a double, b double, won double")
    below = Window.partitionBy(*keys, "draw").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    won = parts.withColumn("won", F.col("won") + F.col("a") * F.coalesce(F.sum("b").over(below), F.lit(0.0)))
    areas = won.groupBy(*keys, "draw").agg(F.try_divide(F.sum("won"), F.sum("a") * F.sum("b")).alias("a"))
    if rule == "index":
        s = areas.groupBy(*keys).agg(F.sort_array(F.collect_list("a")).alias("s"))  # one number a draw; nulls aren't collected
        pick = lambda q: F.try_element_at("s", F.least(F.floor(q * F.size("s")) + 1, F.greatest(F.size("s"), F.lit(1))).cast("int"))
        out = s.select(*keys, pick(alpha / 2).alias("lo"), pick(1 - alpha / 2).alias("hi"))
    else:
        out = areas.groupBy(*keys).agg(F.percentile("a", alpha / 2).alias("lo"), F.percentile("a", 1 - alpha / 2).alias("hi"))
    return out if fallback is None else out.withColumns({"lo": F.coalesce("lo", F.lit(fallback[0])), "hi": F.coalesce("hi", F.lit(fallback[1]))})


def verdict(auc: str = "auc", bands: tuple[tuple[float, str], ...] = ((0.95, "excellent"), (0.90, "very good"), (0.85, "good")), other: str = "lower than expected"):
    """The first band whose floor the area reaches."""
    out = None
    for floor, name in bands:
        hit = F.col(auc) >= floor
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def gap_verdict(gap: str = "gap"):
    """How well a detector carries over, from the difference of its areas."""
    return F.when(F.abs(gap) < 0.05, "excellent").when(F.abs(gap) < 0.10, "good").otherwise("overfit")


def stars(p: str = "p"):
    return F.when(F.col(p) < 0.001, "***").when(F.col(p) < 0.01, "**").when(F.col(p) < 0.05, "*").otherwise("ns")
