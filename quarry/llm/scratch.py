"""Tables in the folder that driver and executors share, Arrow functions, and joins that spread frequent keys."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go on a single machine whose session names no shared folder.
LOCAL = "/tmp/checkpoints/quarry"


def folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; LOCAL where it is unset and all tasks run on this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or LOCAL).rstrip("/")


class Scratch:
    """Writes intermediate tables below the shared folder; ``drop`` deletes those that no result reads any more.

    What is left is deleted when the driver's JVM ends, as results read it until then; ``opened`` gives the folders
    made while a function runs, for callers that can tell earlier.
    """

    opened: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{folder(spark)}/quarry-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        for made in Scratch.opened:
            made.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.top}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.top}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.top}/{name}")

    def clear(self) -> None:
        self._delete(self.top)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives freed memory back to the system; Python workers are kept for later tasks and would hold it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose tasks leave no freed memory behind in their worker."""

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[pa.RecordBatch]]]:
    """Groups of a stream that is sorted by ``key``: the key, and an iterator of its rows that must be consumed."""
    state: dict = {"next": None}

    def pull() -> pa.RecordBatch | None:
        if state["next"] is not None:
            out, state["next"] = state["next"], None
            return out
        for b in batches:
            if b.num_rows:
                return b
        return None

    def own(k) -> Iterator[pa.RecordBatch]:
        while (b := pull()) is not None:
            keys = b.column(key).to_numpy(zero_copy_only=False)
            n = int(np.searchsorted(keys, k, "right"))
            if n:
                yield b.slice(0, n)
            if n < b.num_rows:
                state["next"] = b.slice(n)
                return

    while (b := pull()) is not None:
        state["next"] = b
        k = b.column(key)[0].as_py()
        yield k, own(k)


def pack64(ascending: np.ndarray) -> bytes:
    """Ascending 64-bit numbers: the first, and gaps of as many bytes as the widest takes."""
    if not len(ascending):
        return b""
    gaps = np.diff(ascending)
    wide = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([wide]) + ascending[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def unpack64(blob) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8) if len(blob) else np.zeros(0, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    wide = int(raw[0])
    gaps = np.zeros(((len(raw) - 9) // wide + 1, 8), np.uint8)
    gaps[0] = raw[1:9]
    gaps[1:, :wide] = raw[9:].reshape(-1, wide)
    return np.cumsum(gaps.reshape(-1).view(np.uint64), dtype=np.uint64)


#: A key with more than this part of all rows is joined by broadcast; there are fewer of these than this number.
HEAVY = 2048


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], sizes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """rows joined to ``table``, which has one row for each key, so that no task gets all rows of a frequent key.

    sizes: keys and ``size``, the rows of each.  Keys of more than a HEAVY-th of all rows are fewer than HEAVY, so what is
    broadcast is bounded; no other key has more.
    """
    sizes = scratch.keep(sizes, name)
    total = int(sizes.agg(F.sum("size")).first()[0] or 0)
    often = F.broadcast(sizes.where(F.col("size") * HEAVY > total).select(*keys))
    many = rows.join(F.broadcast(table.join(often, keys, "left_semi")), keys)
    return many.unionByName(rows.join(often, keys, "left_anti").join(table, keys))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
