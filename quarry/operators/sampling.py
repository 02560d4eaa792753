"""Seeded samples, holdouts and folds whose order is a hash of id and seed, the same on any partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import ranks


def order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def stratified(df: DataFrame, id_col: str, per_class: dict[int, int], seed: int = 42, label: str = "y", strict: bool = False) -> DataFrame:
    """n rows of each class, each a top-n of which tasks send n rows at most; ``strict`` raises if a class is short."""
    if strict:
        have = {r[label]: r["count"] for r in df.where(F.col(label).isin(list(per_class))).groupBy(label).count().collect()}
        short = {k: n for k, n in per_class.items() if have.get(k, 0) < n}
        if short:
            raise ValueError(f"classes with too few rows: {short}")
    return reduce(DataFrame.unionByName, [df.where(F.col(label) == k).orderBy(order(id_col, seed), id_col).limit(n) for k, n in per_class.items()])


def holdout(df: DataFrame, id_col: str, per_class: dict[int, int], seed: int = 42, label: str = "y", by_content: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A sample and the rest; ``by_content`` also takes rows equal to a sampled one out of the rest."""
    sample = stratified(df, id_col, per_class, seed, label)
    if by_content:
        key = F.sha2(F.to_json(F.struct(*by_content)), 256)
        return sample, df.withColumn("_k", key).join(sample.select(key.alias("_k")).distinct(), "_k", "left_anti").drop("_k")
    return sample, df.join(sample.select(id_col), id_col, "left_anti")


def simple(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(order(id_col, seed), id_col).limit(n)


def folds(df: DataFrame, id_col: str, k: int = 5, seed: int = 42, label: str = "y") -> DataFrame:
    """Stratified folds: the row's number in its class, by hash, modulo k.  Hashes are even, so their first digits are ranges."""
    hashed = df.withColumn("_hash", order(id_col, seed))
    placed = ranks.numbered(hashed, [label], F.substring("_hash", 1, 2), ["_hash", id_col], "_r")
    return placed.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_hash", "_r")


def few_folds(positives: int) -> int:
    """Folds for small studies: 3, or 2 below three positives."""
    return 2 if positives < 3 else 3
