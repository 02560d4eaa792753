"""ROC and PR analytics from one cumulative table by distinct score.

Scores are summed by distinct value first (with map-side combination), so running sums are over distinct scores and not
over rows, and over ranges of them, so a group of very many scores isn't one task's; all of F1-F12 are projections of that
table.  ``keys`` name the groups, e.g. dataset, domain, feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import ranks


def by_score(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "value").agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("n"))


def cumulative(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, p, n and for either class the rows of smaller scores (below_p, below_n) and of all (all_p, all_n)."""
    return ranks.running(by_score(df, keys), keys, "value", ["p", "n"])


def auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Tie-aware area: negatives below count one, tied ones a half.  Null for a single class."""
    won = cumulative(df, keys).withColumn("won", F.col("p") * (F.col("below_n") + F.col("n") / 2))
    return won.groupBy(*keys).agg(F.try_divide(F.sum("won"), F.sum("p") * F.sum("n")).alias("auc"), F.sum("p").cast("long").alias("pos"), (F.sum("p") + F.sum("n")).cast("long").alias("n"))


def auc_or_half(df: DataFrame, keys: list[str]) -> DataFrame:
    """The area without a NaN policy: one NaN or null score in a group makes it 0.5."""
    bad = df.groupBy(*keys).agg(F.max(F.isnan("value") | F.col("value").isNull()).alias("bad"))
    own = auc(df.where(F.col("value").isNotNull()), keys)
    bad = bad.withColumnsRenamed({k: f"_{k}" for k in keys})
    return bad.join(own, ranks.same(keys), "left").select(*[F.col(f"_{k}").alias(k) for k in keys], F.when(F.col("bad"), F.lit(0.5)).otherwise(F.col("auc")).alias("auc"))


def pearson() -> Column:
    return F.try_divide(F.covar_pop("value", F.col("y").cast("double")), F.stddev_pop("value") * F.stddev_pop(F.col("y").cast("double")))


def directed(df: DataFrame, keys: list[str], rule: str = "auc") -> DataFrame:
    """auc with a direction: by the area, by Pearson (< 0 flips), strictly (only > 0 keeps), inverted (> 0 flips), or not at all."""
    found = auc(df, keys)
    if rule == "auc":
        flip = F.col("auc") < 0.5
    elif rule == "none":
        flip = F.lit(False)
    else:
        found = found.join(df.groupBy(*keys).agg(pearson().alias("corr")), keys)
        up, down = (F.coalesce(x, F.lit(False)) for x in (F.col("corr") > 0, F.col("corr") < 0))
        flip = {"pearson": down, "pearson_strict": ~up, "inverted": up}[rule]
    return found.withColumn("direction", F.when(flip, "Negative").otherwise("Positive")).withColumn("auc", F.when(flip, 1 - F.col("auc")).otherwise(F.col("auc")))


def curve(df: DataFrame, keys: list[str], start: bool = False) -> DataFrame:
    """threshold, tp, fp and totals for "value >= threshold"; with ``start`` also the point that predicts nothing."""
    at_least = lambda c: (F.col(f"all_{c}") - F.col(f"below_{c}"))
    table = cumulative(df, keys).select(*keys, F.col("value").alias("threshold"), at_least("p").alias("tp"), at_least("n").alias("fp"), F.col("all_p").alias("pos"), F.col("all_n").alias("neg"))
    if start:
        top = table.groupBy(*keys).agg(F.first("pos").alias("pos"), F.first("neg").alias("neg")).withColumns({"threshold": F.lit(float("inf")), "tp": F.lit(0.0), "fp": F.lit(0.0)})
        table = table.unionByName(top)
    return rates(table)


def rates(df: DataFrame, guarded: bool = True) -> DataFrame:
    """tpr (recall), fpr, specificity, balanced accuracy, precision, f1; where a divisor is 0, 0 if guarded, else null."""
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)) if guarded else F.try_divide(a, b)
    out = df.withColumns({"tpr": z(F.col("tp"), F.col("pos")), "fpr": z(F.col("fp"), F.col("neg")), "precision": z(F.col("tp"), F.col("tp") + F.col("fp"))})
    return out.withColumns({"specificity": 1 - F.col("fpr"), "balanced": (F.col("tpr") + 1 - F.col("fpr")) / 2, "j": F.col("tpr") - F.col("fpr"), "f1": z(2 * F.col("precision") * F.col("tpr"), F.col("precision") + F.col("tpr") + F.lit(1e-8))})


def detected(points: DataFrame) -> DataFrame:
    """tp = recall x positives and detected, its nearest whole number, from points of a curve."""
    return points.withColumns({"tp": F.col("tpr") * F.col("pos"), "detected": F.round(F.col("tpr") * F.col("pos")).cast("long")})


def best(df: DataFrame, keys: list[str], objective: str = "youden", floor: float = 0.005) -> DataFrame:
    """One operating point a group: highest J then threshold; highest F1 then lowest threshold; or highest precision with
    recall above ``floor``, then recall, then lowest threshold."""
    points = curve(df, keys, start=objective == "youden")
    rank = {"youden": F.struct("j", "threshold"), "f1": F.struct("f1", -F.col("threshold")), "precision": F.struct("precision", "tpr", -F.col("threshold"))}[objective]
    if objective == "precision":
        points = points.where(F.col("tpr") > floor)
    cols = [c for c in points.columns if c not in keys]
    return points.groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("b")).select(*keys, "b.*")


def predicted(comparator: str, threshold: Column | str = "threshold", value: str = "value") -> Column:
    t, v = F.col(threshold) if isinstance(threshold, str) else threshold, F.col(value)
    return {">=": v >= t, ">": v > t, "<": v < t}[comparator]


def confusion(df: DataFrame, keys: list[str], thresholds: DataFrame, comparator: str = ">=", guarded: bool = True) -> DataFrame:
    """tp, fp, fn, tn and rates of thresholds (keys, threshold) applied to rows, e.g. calibrated on other data."""
    hit, y = predicted(comparator), F.col("y") == 1
    n = lambda c: F.count_if(c).cast("double")
    counts = df.join(F.broadcast(thresholds.select(*keys, "threshold")), keys).groupBy(*keys).agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"), n(~hit & ~y).alias("tn"), n(y).alias("pos"), n(~y).alias("neg"))
    return rates(counts, guarded)


def class_report(df: DataFrame, keys: list[str], thresholds: DataFrame, comparator: str = ">=") -> DataFrame:
    """precision, recall, f1, support of either class."""
    c = confusion(df, keys, thresholds, comparator)
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("class"), F.col("tn").alias("hit"), (F.col("tn") + F.col("fn")).alias("said"), F.col("neg").alias("support")), F.struct(F.lit(1).alias("class"), F.col("tp").alias("hit"), (F.col("tp") + F.col("fp")).alias("said"), F.col("pos").alias("support"))))
    rows = c.select(*keys, sides.alias("s")).select(*keys, "s.*").withColumns({"precision": z(F.col("hit"), F.col("said")), "recall": z(F.col("hit"), F.col("support"))})
    return rows.select(*keys, "class", "precision", "recall", z(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), F.col("support").cast("long").alias("support"))
