"""Operator 7, approximate nearest neighbours by a hash-prefix forest.

Each vector gets, for each of TREES trees, a string of DEPTH sign bits of random projections; a tree is the sorted array
of these strings.  Vectors are dealt by the order of the first tree's strings into blocks of about ``block``, so that
what lies close lies in one block, and each block holds a forest of its own, in bands of similar norms.

 1. *Descent.*  A query descends in the forest of its own block to the longest prefixes that it shares with other rows,
    by binary search in all trees, and ascends synchronously, a bit at a time in all of them, until some 4 k rows are
    met.  The k best of these are in its list, and the last one's score is a bound that any better neighbour must pass.
 2. *Ascent.*  With that bound the query ascends in each block's forest, in all trees at once, as far as rows that could
    pass it are likely to be: nearness is the inner product, so a row of a band whose norms reach n passes only if its
    cosine is above bound / n.  Rows within that angle share a prefix of p bits with probability s ** p or more in a tree,
    s = 1 - angle / pi, so the chance to miss one in all trees is at most (1 - s ** p) ** TREES.  The longest p for which
    that is below ``miss`` ends the ascent; the rows under the prefixes are scored.  A band whose cosine would have to be
    above 1 isn't entered.  If the prefixes would hold most of the band, the ascent is at the root: every row is scored,
    which is exact.  There is no cap on candidates.

A query with near neighbours meets a few rows of each block; one without, in data that has no structure around it, is
scored against most rows, as no index can tell them apart.  Queries are a stated set against all rows, in blocks: each
query goes to each block once, and a block's forest is built once for QUERIES queries.

Equal vectors are searched for once; of their rows the k + 1 of smallest vec_id are candidates, as no others can be
among k nearest of any query.  So a vector that a third of all rows share costs no more than others.

Edge cases: a null vector, a zero one and one with null, NaN or infinite components takes no part, as query or
candidate; so does one whose length differs from the most frequent length, and a null vec_id; repeated vectors tie and
the smaller vec_id comes first; rows that repeat vec_id and vector are one; rows of one vec_id with different vectors are
candidates each, and the query of that vec_id is the vector of smallest hash; with fewer candidates than ``k`` all are
returned; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.scratch import Scratch, mapped, runs

TREES, DEPTH, SEED = 16, 32, 7
#: Rows of a band; queries for which a block is sent once; queries that are looked up together.
BAND, QUERIES, STEP = 4096, 1 << 17, 512
#: What single precision may lose of a cosine.
SLACK = 1e-5


def planes(width: int, trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, trees * depth)).astype(np.float32)


def strings(rows: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """trees x rows strings of ``depth`` bits, as integers whose highest bit is the first."""
    out = np.empty((trees, len(rows)), np.uint64)
    weigh, sides = np.uint64(1) << np.arange(depth - 1, -1, -1, dtype=np.uint64), planes(rows.shape[1], trees, depth)
    for a in range(0, len(rows), 1024):
        bits = (rows[a : a + 1024].astype(np.float32) @ sides > 0).reshape(-1, trees, depth)
        out[:, a : a + 1024] = (bits * weigh).sum(axis=2, dtype=np.uint64).T
    return out


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.linalg.norm(rows, axis=1)
    return (rows / np.maximum(norm, 1e-300)[:, None]).astype(np.float32), norm


class Forest:
    """The sorted strings of some rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        self.ids, self.rows, self.trees, self.depth = ids, rows, trees, depth
        self.fast, self.norm = unit(rows)
        found = strings(rows, trees, depth)
        self.order = np.argsort(found, axis=1, kind="stable")
        self.sorted = np.take_along_axis(found, self.order, axis=1)

    def ranges(self, wanted: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last + 1 place of each query's prefix of so many bits: trees x queries."""
        shift = (self.depth - bits).astype(np.uint64)
        low = (wanted >> shift) << shift
        high = low + (np.uint64(1) << shift)
        return tuple(np.stack([np.searchsorted(self.sorted[t], x[t]) for t in range(self.trees)]) for x in (low, high))

    def under(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The rows of one query's ranges."""
        return np.unique(np.concatenate([self.order[t, a:b] for t, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True))]))

    def descend(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of each query's k best longest-prefix matches, best first; all rows if there are fewer."""
        out, wanted = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries), strings(queries, self.trees, self.depth)
        bits, todo = np.full(len(queries), self.depth), np.arange(len(queries))
        while len(todo):
            lo, hi = self.ranges(wanted[:, todo], bits[todo])
            enough = ((hi - lo).sum(axis=0) >= 4 * k) | (bits[todo] == 0)
            rest = []
            for j in np.flatnonzero(enough):
                q = todo[j]
                met = self.under(lo[:, j], hi[:, j])
                if len(met) < k and bits[q]:
                    rest.append(q)
                    continue
                score = (self.rows[met] * queries[q]).sum(axis=1)
                best = np.lexsort((self.ids[met], -score))[:k]
                out[q] = self.ids[met][best], score[best]
            todo = np.concatenate([todo[~enough], np.asarray(rest, np.int64)])
            bits[todo] -= 1
        return out

    def search(self, queries: np.ndarray, bound: np.ndarray, k: int, miss: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ascent: for each query ids and exact scores of its k best rows found that pass its bound, best first."""
        near, norm = unit(queries)
        top = self.norm.max() * np.maximum(norm, 1e-300)
        cosine = bound / np.where(bound >= 0, top, self.norm.min() * np.maximum(norm, 1e-300))
        none = (np.zeros(0, np.int64), np.zeros(0))
        out = [none] * len(queries)
        live = np.flatnonzero(cosine <= 1 + SLACK)
        s = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
        with np.errstate(divide="ignore"):
            bits = np.log(1 - miss ** (1 / self.trees)) / np.log(np.clip(s, 1e-300, 1 - 1e-12))
        bits = np.clip(np.floor(bits), 0, self.depth).astype(np.int64)
        if not len(live):
            return out
        lo, hi = self.ranges(strings(queries, self.trees, self.depth)[:, live], bits[live])
        root = (hi - lo).sum(axis=0) >= len(self.ids)
        for at, q in zip(np.flatnonzero(~root), live[~root], strict=True):
            met = self.under(lo[:, at], hi[:, at])
            out[q] = self._best(met, self.fast[met] @ near[q] * self.norm[met], queries[q], norm[q], bound[q], k)
        every = np.arange(len(self.ids))
        for a in range(0, int(root.sum()), 64):
            some = live[root][a : a + 64]
            cos = near[some] @ self.fast.T
            for q, c in zip(some, cos, strict=True):
                out[q] = self._best(every, c * self.norm, queries[q], norm[q], bound[q], k)
        return out

    def _best(self, met: np.ndarray, score: np.ndarray, query: np.ndarray, norm: float, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the rows met; exact scores for all that single precision can't tell from the last."""
        score = score * norm
        slack = SLACK * self.norm.max() * norm
        keep = score >= bound - slack
        if keep.sum() > 2 * k:
            keep &= score >= np.partition(score, len(score) - k)[len(score) - k] - 2 * slack
        met = met[keep]
        exact = (self.rows[met] * query).sum(axis=1)
        best = np.lexsort((self.ids[met], -exact))[:k]
        return self.ids[met][best], exact[best]


def bands(ids: np.ndarray, rows: np.ndarray) -> list[Forest]:
    """Forests of rows of similar norms."""
    order = np.argsort(np.linalg.norm(rows, axis=1), kind="stable")
    return [Forest(ids[o], rows[o]) for o in np.array_split(order, max(1, -(-len(order) // BAND))) if len(o)]


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, block: int = 16384, miss: float = 0.02) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found; queries are rows with vec_id % every == 0."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    width = F.size("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x)) > 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    top = rows.groupBy(width.alias("w")).count().orderBy(F.desc("count"), "w").first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    keys = ["h1", "h2"]
    rows = rows.where(width == top["w"]).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")}).dropDuplicates(["vec_id", *keys])
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct(*keys)).alias("h")).select(F.col("vec_id").alias("query_id"), "h.*")
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
    kept = rows.withColumn("copy", copy).where(F.col("copy") <= k + 1)
    # the first copy asks for all of them if any is a query
    asked = queries.select(*keys).distinct().withColumn("asked", F.lit(True))
    kept = kept.join(asked, keys, "left").withColumn("ask", F.coalesce("asked", F.lit(False)) & (F.col("copy") == 1)).drop("asked", "copy")

    def first(batches):
        """The first tree's string, for the order of the blocks."""
        for b in batches:
            s = strings(_matrix(b), 1) if b.num_rows else np.zeros((1, 0), np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s[0].view(np.int64))], names=[*b.schema.names, "place"])

    def descend(batches):
        number = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ids, x = np.concatenate([b.column("vec_id").to_numpy() for b in held]), np.concatenate([_matrix(b) for b in held])
        ask = np.concatenate([b.column("ask").to_numpy(zero_copy_only=False) for b in held])
        found: list = [None] * len(ids)
        at = np.flatnonzero(ask)
        if len(at):
            forest = Forest(ids, x)
            for a in range(0, len(at), STEP):
                for i, (near, score) in zip(at[a : a + STEP], forest.descend(x[at[a : a + STEP]], k + 1), strict=True):
                    found[i] = [{"vec_id": int(v), "score": float(s)} for v, s in zip(near, score, strict=True)]
        done = 0
        for b in held:
            own = found[done : done + b.num_rows]
            done += b.num_rows
            bound = [x[-1]["score"] if x is not None and len(x) > k else -np.inf for x in own]
            more = [pa.array(np.full(b.num_rows, number), pa.int32()), pa.array(bound, pa.float64()), pa.array(own, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "embedding", "h1", "h2", "ask")), *more], names=["vec_id", "embedding", "h1", "h2", "ask", "block", "bound", "met"])

    schema = "vec_id long, embedding array<double>, h1 long, h2 long, ask boolean"
    placed = scratch.keep(mapped(kept.select("vec_id", "embedding", "h1", "h2", "ask"), first, schema + ", place long"), "placed")
    blocks = max(1, -(-placed.count() // block))
    dealt = placed.repartitionByRange(blocks, "place", "h1").select("vec_id", "embedding", "h1", "h2", "ask")
    index = scratch.keep(mapped(dealt, descend, schema + ", block int, bound double, met array<struct<vec_id:long,score:double>>"), "index")
    batches = max(1, -(-index.where("ask").count() // QUERIES))

    side = ["cell", "kind", "vec_id", "embedding", "h1", "h2", "bound"]
    cell = lambda b, q: b * batches + q
    own = index.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).withColumns({"cell": cell(F.col("block"), F.col("q")), "kind": F.lit(0)})
    q = F.pmod(F.xxhash64("h1", "h2"), F.lit(batches)).cast("int")
    asking = index.where("ask").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"cell": cell(F.col("block"), q), "kind": F.lit(1)})
    cells = own.select(*side).unionByName(asking.select(*side)).repartition(max(1, min(blocks * batches, 4096)), "cell").sortWithinPartitions("cell", "kind")

    def ascend(stream):
        for _, own in runs(stream, "cell"):
            ids, vecs, forests = [], [], None
            for b in own:
                kind = b.column("kind").to_numpy()
                n = int(np.searchsorted(kind, 1))
                if n:
                    ids.append(b.column("vec_id").slice(0, n).to_numpy())
                    vecs.append(_matrix(b.slice(0, n)))
                if n == b.num_rows or not ids:
                    continue
                forests = forests or bands(np.concatenate(ids), np.concatenate(vecs))
                for a in range(n, b.num_rows, STEP):
                    some = b.slice(a, STEP)
                    x, bound = _matrix(some), some.column("bound").to_numpy()
                    parts = [f.search(x, bound, k + 1, miss) for f in forests]
                    h1, h2 = some.column("h1").to_numpy(), some.column("h2").to_numpy()
                    size = [sum(len(p[i][0]) for p in parts) for i in range(len(x))]
                    got = [p[i] for i in range(len(x)) for p in parts]
                    yield pa.RecordBatch.from_pydict({
                        "h1": pa.array(np.repeat(h1, size), pa.int64()), "h2": pa.array(np.repeat(h2, size), pa.int64()),
                        "vec_id": pa.array(np.concatenate([g[0] for g in got]), pa.int64()), "score": pa.array(np.concatenate([g[1] for g in got]), pa.float64()),
                    })

    found = mapped(cells, ascend, "h1 long, h2 long, vec_id long, score double")
    met = index.where("ask").select("h1", "h2", F.explode("met").alias("m")).select("h1", "h2", "m.*")
    order = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    best = found.unionByName(met).withColumn("place", order).where(F.col("place") <= k + 1).dropDuplicates([*keys, "vec_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    mine = queries.join(best, keys).where(F.col("vec_id") != F.col("query_id")).withColumn("rank", rank)
    return mine.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_hash_prefix_forest(vectors: DataFrame) -> DataFrame:
    return nearest(vectors)
