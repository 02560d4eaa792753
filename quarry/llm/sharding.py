"""Operator 3, sharding by vector bin packing: bytes, tokens and rows are balanced jointly under the law ``bytes``.

Rows of equal texts form a group.  A group larger than a small part of a shard is split into pieces; all groups are
hashed into CELLS cells, whose vectors (bytes, words, rows) are summed before the shuffle.  The cells, at most
CELLS rows however large the input, are packed on the driver: largest first, each into the shard where the dot product
of its vector with the shard's residual capacity is highest; then cells move or swap between shards while that brings
the bytes nearer.  Slots are numbered by cell, so no task ranks a whole shard.

Edge cases: a null text counts as no bytes (size 8, crc32 of nothing, 0) and nulls are equal texts; repeated rows get
slots of their own; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
#: Cells that are packed; bounds what the driver gets and what is broadcast.
CELLS = 4096
#: Bytes that a row counts besides its text.
HEAD = 8


def pack_vectors(load: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of ``load`` (bytes, tokens, rows): dot-product packing, then moves and swaps by bytes."""
    n = len(load)
    total = np.maximum(load.sum(axis=0), 1e-9)
    share = load / total
    left = np.full((shards, load.shape[1]), 1.0 / shards)
    place = np.zeros(n, np.int64)
    for i in np.lexsort((np.arange(n), -share.max(axis=1))):
        fits = (left >= share[i] - 1e-12).all(axis=1)
        score = left @ share[i]
        score = np.where(fits, score, score - 10.0) if fits.any() else score
        place[i] = s = int(score.argmax())
        left[s] -= share[i]
    size = load[:, 0].astype(np.float64)
    sums = np.bincount(place, weights=size, minlength=shards)
    for _ in range(20 * shards):
        hi, lo = int(sums.argmax()), int(sums.argmin())
        gap = sums[hi] - sums[lo]
        own, other = np.flatnonzero(place == hi), np.flatnonzero(place == lo)
        own = own[size[own] > 0]
        if gap <= 1 or not len(own):
            break
        # a move of x changes the gap by 2x, a swap by twice the difference; x nearest to half the gap is best
        give = np.concatenate([size[own], (size[own][:, None] - size[other][None, :]).ravel()])
        k = int(np.abs(give - gap / 2).argmin())
        if not 0 < give[k] < gap:
            break
        if k < len(own):
            place[own[k]] = lo
        else:
            a, b = divmod(k - len(own), len(other))
            place[own[a]], place[other[b]] = lo, hi
        sums[hi] -= give[k]
        sums[lo] += give[k]
    return place


def shard(docs: DataFrame, shards: int = 24, cells: int = CELLS) -> DataFrame:
    """doc_id, size, tokens, text_crc32, law, shard, slot and grown_shard (null) for every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + HEAD).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_key"),
    )
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    sums = groups.agg(F.sum("size"), F.sum("n")).first()
    whole, count = int(sums[0] or 0), int(sums[1] or 0)
    # a group above a 16th of a shard, in bytes or rows, is split; there are fewer than 32 x shards such groups
    most, most_rows = max(1.0, whole / shards / 16), max(1.0, count / shards / 16)
    pieces = F.greatest(F.ceil(F.col("size") / F.lit(most)), F.ceil(F.col("n") / F.lit(most_rows)))
    split = groups.where((F.col("n") > 1) & ((F.col("size") > most) | (F.col("n") > most_rows))).select(F.col("text_key").alias("_key"), F.least(pieces * 2, F.col("n")).cast("int").alias("pieces"))
    dealt = (
        rows.join(F.broadcast(split), F.col("text_key") == F.col("_key"), "left")
        .withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(F.lit(0)).cast("int"))
        .withColumn("cell", F.pmod(F.xxhash64("text_key", "piece"), F.lit(cells)).cast("int"))
    )
    loads = dealt.groupBy("cell").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")).orderBy("cell").limit(cells).collect()
    place = pack_vectors(np.array([[x["b"], x["t"], x["r"]] for x in loads], np.float64), shards) if loads else []
    before = [0] * shards
    table = []
    for x, s in zip(loads, map(int, place), strict=True):
        table.append((x["cell"], s, before[s]))
        before[s] += x["r"]
    where = spark.createDataFrame(table, "_cell int, shard int, first long")
    order = Window.partitionBy("cell").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("_at", F.row_number().over(order) - 1)
        .join(F.broadcast(where), F.col("cell") == F.col("_cell"))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("_at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
    )


def op3_vector_packing(docs: DataFrame) -> DataFrame:
    return shard(docs)
