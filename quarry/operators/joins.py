"""Joins that detector studies imply: by position, by a configuration's features, by an optional lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import ranks


def positional_zip(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Row i of either table side by side, in the order of a numeric column and ties; raises if their lengths differ.

    Both are numbered by ranges, so no task holds a whole table.
    """
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows can't be zipped with {b}")
    number = lambda df, order: ranks.numbered_by(df, order[0], order[1:], "position")
    return number(left, left_order).join(number(right, right_order), "position")


def of_configs(long: DataFrame, configs: DataFrame) -> DataFrame:
    """Rows of the long table for each configuration (config, features) that names their feature."""
    named = configs.select("config", F.explode("features").alias("feature"))
    return long.join(named, "feature")


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """All rows, with what ``table`` has for their key, or nulls."""
    return rows.join(table, key, "left")


def with_known_features(configs: DataFrame, long: DataFrame) -> DataFrame:
    """Configurations all of whose features the table has."""
    known = long.select("feature").distinct()
    lost = configs.select("config", F.explode("features").alias("feature")).join(known, "feature", "left_anti").select("config").distinct()
    return configs.join(lost, "config", "left_anti")


def same_features(a: Column | str, b: Column | str) -> Column:
    """Whether two lists name the same set."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
