"""Readers and writers of records, feature tables and result files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
RECORD = T.StructType([
    T.StructField("system", T.StringType()), T.StructField("input_messages", T.ArrayType(MESSAGE)), T.StructField("ground_truth", T.StringType()),
    T.StructField("generated", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("domain_match", T.BooleanType()), T.StructField("user", T.StringType()),
])
BASELINE = "is_hallucination int, ppl double, logprob_mean double, logprob_min double, len_gen int"


def jsonl(spark: SparkSession, path: str, schema=RECORD, strict: bool = True) -> DataFrame:
    """Records of one JSON object a line; a bad line fails the read, or is dropped if not ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def jsonl_counted(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> tuple[DataFrame, DataFrame]:
    """The good records, and one row with how many lines were read and how many dropped."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = lines.select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    bad = F.col("_corrupt_record").isNotNull()
    return raw.where(~bad).drop("_corrupt_record"), raw.agg(F.count("*").alias("lines"), F.count_if(bad).alias("dropped"))


def hub(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None, key: str | None = None) -> DataFrame:
    """A data set that was fetched from a hub as Parquet, whole, or a page of it in the order of ``key``."""
    df = spark.read.parquet(path)
    if key is None:
        if offset or limit is not None:
            raise ValueError("a page needs a key to be ordered by")
        return df
    return page(df, offset, limit, key) if limit is not None else df.orderBy(key).offset(offset)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, for inputs with a fallback."""
    for p in paths:
        if _exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def sweep(spark: SparkSession, path: str, layers: int, metrics=("HFER", "Fiedler", "Smoothness", "Entropy")) -> DataFrame:
    """A wide table of per-layer metrics with a declared schema."""
    return csv(spark, path, "is_hallucination int, " + ", ".join(f"L{i}_{m} double" for i in range(layers) for m in metrics))


def named_files(spark: SparkSession, pattern: str, schema: str, suffix: str = "_ppl", prefix: str | None = None) -> DataFrame:
    """Files of a glob with the column ``dataset``: the stem without suffix, blanks for underscores, words capitalised;
    with ``prefix`` the stem after it, its first letter capitalised."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    if prefix is None:
        name = F.initcap(F.regexp_replace(F.replace(stem, F.lit(suffix), F.lit("")), "_", " "))
    else:
        own = F.replace(stem, F.lit(prefix), F.lit(""))
        name = F.concat(F.upper(F.substring(own, 1, 1)), F.lower(F.substring(own, 2, 1 << 20)))
    return csv(spark, pattern, schema).withColumn("dataset", name)


def tagged(spark: SparkSession, paths: dict[str, str], schema: str, optional: bool = True) -> DataFrame:
    """Files by name in one table; missing ones are left out if ``optional``."""
    parts = [csv(spark, p, schema).withColumn("dataset", F.lit(name)) for name, p in paths.items() if not optional or _exists(spark, p)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema + ", dataset string")


def parallel_turns(df: DataFrame, column: str = "conversations") -> DataFrame:
    """Columnar conversations {from[], value[]} as an array of (role, content)."""
    pairs = F.arrays_zip(F.col(f"{column}.from").alias("role"), F.col(f"{column}.value").alias("content"))
    return df.withColumn("messages", F.transform(pairs, lambda p: F.struct(p["role"].alias("role"), p["content"].alias("content"))))


def page(df: DataFrame, offset: int, limit: int, key: str) -> DataFrame:
    """Rows offset .. offset + limit in the order of ``key``."""
    return df.orderBy(key).offset(offset).limit(limit)


def write_by(df: DataFrame, path: str, key: str) -> None:
    """A folder for each lower-cased value of ``key``."""
    df.withColumn(key, F.lower(key)).write.mode("overwrite").partitionBy(key).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in each file; lists and structs must be made text before."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key the table at ``path`` lacks; running it again adds nothing."""
    spark = df.sparkSession
    if _exists(spark, path):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df.write.mode("append").parquet(path)


def derived(path: str, ending: str) -> str:
    return path.replace(".csv", f"{ending}.csv")
