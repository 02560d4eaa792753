"""Operator 4, LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(token | before) = P(class | before) P(member | class, before) P(token | member).  A word's class is a hash of its last
two bytes, the end of text is a class of its own.  The members of a class are its MEMBERS - 1 most frequent training words
and one for all its other words.  Both factors are log-linear softmaxes over hashed features of the words before: the last
word and the last two (n-grams), the word before the last and the one before that (skips), beside a prior from counts; the
features of the second factor are hashed with the class.  So context tells words of one class apart too.  A class's other
words share their member by count, and words never seen share what Good-Turing gives to them, as one symbol, so all
tokens' probabilities add up to 1.

Training is one epoch of ROUNDS distributed gradient updates: the training documents are dealt to rounds by a hash of
their id, a round's tasks sum the gradient of their tokens' log-likelihood by feature, and each row of weights moves by
RATE * log((E + gradient) / E), smoothed, where E is what the row alone would expect of its tokens.  A round also gives
the likelihood of its documents under the weights before it, of documents not trained on yet: ``Model.progress``.  Tasks
of a round are twice the cluster's cores, so what is exchanged doesn't grow with the corpus but by the model.

The number of feature rows grows with the square root of the training tokens, from 2**14 to 2**MOST; the bound keeps the
weights, which are broadcast, below 2**MOST * (CLASSES + MEMBERS) * 4 bytes.  Word counts are exact: the most frequent
words, at most HEAD of them by a bound on n, are broadcast; tokens of all other words are joined to the table of counts.
Words are known by 64-bit hashes.

Edge cases: a null or empty text is one end token; without any training text all tokens are unknown; rows that repeat
are scored and counted each; a null doc_id trains; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import text as tx
from quarry.llm.scratch import Scratch, mapped, runs

CLASSES, MEMBERS, HEAD, MOST = 32, 32, 1 << 18, 20
#: Updates, their size, and the tokens that a row's expectation is smoothed by.
ROUNDS, RATE, SMOOTH = 4, 0.4, 4.0
END = np.uint64(0xE4D0F7E87A11C0DE)
BEFORE = np.uint64(0xBE614414640F7E87)
NEVER = np.float32(-1e30)
#: Feature rows in one packed row; tokens that are looked at together, and whose gradients are summed together.
PACK, CHUNK, SUM = 256, 1 << 12, 1 << 16


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes of all tokens of a run of documents, the end included, and the documents' n + 1 offsets."""
    n = len(off) - 1
    data = tx.LOWER[data]
    start, end, wo = tx.words(data, off)
    to = wo + np.arange(n + 1)
    hashes = np.full(len(start) + n, END)
    classes = np.zeros(len(start) + n, np.int64)
    if len(start):
        at = np.arange(len(start)) + np.repeat(np.arange(n), np.diff(wo))
        hashes[at] = tx.span_hash(tx.prefix_hash(data), start, end)
        last = data[end - 1].astype(np.uint64)
        prior = np.where(end - start > 1, data[end - 2], 0).astype(np.uint64)
        classes[at] = (tx.mix(last * np.uint64(257) + prior) % np.uint64(CLASSES - 1)).astype(np.int64) + 1
    return hashes, classes, to


def features(hashes: np.ndarray, classes: np.ndarray, to: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the two factors, 4 x tokens and 3 x tokens; a row of the second belongs to class row % CLASSES."""
    first = np.repeat(to[:-1], np.diff(to))
    at = np.arange(len(hashes)) - first
    back = []
    for k in (1, 2, 3):
        shifted = np.concatenate([np.full(min(k, len(hashes)), BEFORE), hashes[:-k]])[: len(hashes)]
        back.append(np.where(at >= k, shifted, BEFORE))
    a, b, c = back
    pair = a * tx.MULT[1] + b * tx.MULT[2]
    of_class = np.stack([(tx.mix(s) % np.uint64(rows)).astype(np.int64) for s in (a * tx.MULT[0], pair, b * tx.MULT[3], c * tx.MULT[4])])
    inner = [(tx.mix(s + classes.astype(np.uint64) * tx.MULT[5]) % np.uint64(rows // CLASSES)).astype(np.int64) * CLASSES + classes for s in (a * tx.MULT[6], pair, b * tx.MULT[7])]
    return of_class, np.stack(inner)


def softmax(prior: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-linear scores, tokens x outcomes, at most 0; and their exponentials."""
    z = weights[rows[0]]
    for r in rows[1:]:
        z += weights[r]
    z += prior
    z -= z.max(axis=1, keepdims=True)
    return z, np.exp(z)


@dataclass
class Model:
    """prior1 + weights1 score classes, prior2[class] + weights2 members; words sorted by hash, slot = class * MEMBERS + member."""

    weights1: np.ndarray
    weights2: np.ndarray
    prior1: np.ndarray
    prior2: np.ndarray
    words: np.ndarray
    slots: np.ndarray
    rest: np.ndarray  # tokens of a class's other words, and how many of these words occur once
    once: np.ndarray
    total: int
    distinct: int
    progress: list[float] = field(default_factory=list)  # log10 a token of each round's documents before its update

    def members(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), MEMBERS - 1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.slots[at] % MEMBERS, MEMBERS - 1)

    def log_factors(self, hashes: np.ndarray, classes: np.ndarray, to: np.ndarray) -> np.ndarray:
        """log10 of P(class) P(member) of each token."""
        one, two = features(hashes, classes, to, len(self.weights1))
        member, out = self.members(hashes), np.empty(len(hashes))
        for a in range(0, len(hashes), CHUNK):
            s = slice(a, a + CHUNK)
            each = np.arange(len(hashes[s]))
            z, e = softmax(self.prior1, self.weights1, one[:, s])
            y, f = softmax(self.prior2[classes[s]], self.weights2, two[:, s])
            out[s] = z[each, classes[s]] - np.log(e.sum(axis=1)) + y[each, member[s]] - np.log(f.sum(axis=1))
        return out / np.log(10)


def _packed(which: int, matrix: np.ndarray) -> pa.RecordBatch:
    parts = [(p, matrix[p * PACK : (p + 1) * PACK]) for p in range(-(-len(matrix) // PACK))]
    parts = [(p, m) for p, m in parts if m.any()]
    return pa.RecordBatch.from_pydict({"part": pa.array([p * 4 + which for p, _ in parts], pa.int64()), "blob": pa.array([m.astype(np.float32).tobytes() for _, m in parts], pa.binary())})


def _summed(rows: DataFrame, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """Sums of packed arrays over tasks, as many numbers as the shapes say; they come to the driver."""

    def add(batches):
        for part, own in runs(batches, "part"):
            total = None
            for b in own:
                for blob in b.column("blob"):
                    x = np.frombuffer(blob.as_buffer(), np.float32).astype(np.float64)
                    total = x if total is None else total + x
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "blob": pa.array([total.tobytes()], pa.binary())})

    out = [np.zeros(s) for s in shapes]
    for row in mapped(rows.repartition("part").sortWithinPartitions("part"), add, "part long, blob binary").toLocalIterator():
        whole = out[row["part"] % 4]
        part = whole[row["part"] // 4 * PACK : (row["part"] // 4 + 1) * PACK]
        part[:] = np.frombuffer(row["blob"]).reshape(part.shape)
    return out


def _spread(batches):
    for b in batches:
        data, off = tx.utf8(b.column("text"))
        for i, j in tx.slices(off):
            yield (b, i, j, *tokens(data[off[i] : off[j]], off[i : j + 1] - off[i]))


def word_counts(train: DataFrame) -> DataFrame:
    """word (hash), class, n of every training token."""

    def run(batches):
        held, size = [], 0

        def flush():
            h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, where = np.unique(h, return_index=True, return_inverse=True)
            return u, c[first], np.bincount(where, weights=n, minlength=len(u)).astype(np.int64)

        for _, _, _, h, c, _ in _spread(batches):
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, c[first], n))
            size += len(u)
            if size > 4_000_000:
                held = [flush()]
                size = len(held[0][0])
                if size > 3_000_000:
                    yield pa.RecordBatch.from_pydict({"word": pa.array(held[0][0].view(np.int64)), "class": pa.array(held[0][1], pa.int32()), "n": pa.array(held[0][2])})
                    held, size = [], 0
        if held:
            u, c, n = flush()
            for k in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_pydict({"word": pa.array(u[k : k + 100_000].view(np.int64)), "class": pa.array(c[k : k + 100_000], pa.int32()), "n": pa.array(n[k : k + 100_000])})

    return mapped(train.select("text"), run, "word long, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


def _gradient(sums: np.ndarray, counts: np.ndarray, rows: np.ndarray, change: np.ndarray) -> None:
    """Adds each token's change (outcomes x tokens) to the feature rows it has."""
    for r in rows:
        counts += np.bincount(r, minlength=len(counts))
        for outcome, own in zip(sums, change, strict=True):
            outcome += np.bincount(r, weights=own, minlength=len(counts))


def _moved(weights: np.ndarray, prior: np.ndarray, gradient: np.ndarray, counts: np.ndarray, rate: float, smooth: float) -> np.ndarray:
    """One update: what a row alone expects of its tokens, against that and the gradient."""
    z = prior + weights
    e = np.exp(z - z.max(axis=1, keepdims=True))
    expected = counts[:, None] * e / e.sum(axis=1, keepdims=True)
    step = rate * np.log((np.maximum(expected + gradient, 0) + smooth) / (expected + smooth))
    return np.where(prior > NEVER / 2, weights + step, weights).astype(np.float32)


def train(docs: DataFrame, counts: DataFrame, rounds: int = ROUNDS, rate: float = RATE, smooth: float = SMOOTH, rows: int | None = None) -> Model:
    """The model of the training documents (doc_id, text), whose word counts are ``counts``."""
    spark = docs.sparkSession
    order = Window.partitionBy("class").orderBy(F.desc("n"), "word")
    tops = counts.withColumn("member", F.row_number().over(order) - 1).where(F.col("member") < MEMBERS - 1).collect()  # at most CLASSES * MEMBERS
    stats = counts.groupBy("class").agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once"), F.count("*").alias("words")).collect()
    per_class, rest, once = np.zeros(CLASSES), np.zeros(CLASSES), np.zeros(CLASSES)
    for x in stats:
        per_class[x["class"]] = rest[x["class"]] = x["n"]
        once[x["class"]] = x["once"]
    prior2 = np.full((CLASSES, MEMBERS), NEVER, np.float32)
    for x in tops:
        rest[x["class"]] -= x["n"]
        once[x["class"]] -= x["n"] == 1
        prior2[x["class"], x["member"]] = np.log(x["n"] / (per_class[x["class"]] + 1))
    prior2[1:, -1] = np.log((rest + once + 1) / (per_class + 1))[1:]
    prior2[0, 0] = 0  # the end of text is its class's only member
    prior1 = np.log((per_class + 1) / (per_class.sum() + CLASSES)).astype(np.float32)
    words = np.array([x["word"] for x in tops], np.int64).view(np.uint64)
    by = np.argsort(words)
    total = int(per_class.sum())
    if rows is None:
        rows = 1 << int(np.clip(np.ceil(np.log2(max(total, 1)) / 2) + 2, 14, MOST))
    model = Model(np.zeros((rows, CLASSES), np.float32), np.zeros((rows, MEMBERS), np.float32), prior1, prior2, words[by], np.array([x["class"] * MEMBERS + x["member"] for x in tops], np.int64)[by], rest, once, total, sum(x["words"] for x in stats))
    inner = np.tile(prior2, (rows // CLASSES, 1))
    dealt = docs.withColumn("_round", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(rounds)))
    tasks = max(1, 2 * spark.sparkContext.defaultParallelism)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def gradient(batches, sent=sent):
            m = sent.value
            sums = [np.zeros((CLASSES, rows)), np.zeros((MEMBERS, rows))]
            seen, likelihood = [np.zeros(rows), np.zeros(rows)], np.zeros((1, 2))
            held: list[tuple] = []

            def add():
                ones, twos, d1, d2 = (np.concatenate(x, axis=1) for x in zip(*held, strict=True))
                _gradient(sums[0], seen[0], ones, d1)
                _gradient(sums[1], seen[1], twos, d2)
                held.clear()

            for _, _, _, h, c, to in _spread(batches):
                one, two = features(h, c, to, rows)
                member = m.members(h)
                for a in range(0, len(h), CHUNK):
                    s = slice(a, a + CHUNK)
                    each, own = np.arange(len(h[s])), member[s]
                    p, q = softmax(m.prior1, m.weights1, one[:, s])[1], softmax(m.prior2[c[s]], m.weights2, two[:, s])[1]
                    p /= p.sum(axis=1, keepdims=True)
                    q /= q.sum(axis=1, keepdims=True)
                    likelihood += (np.log10(np.maximum(p[each, c[s]], 1e-30)).sum(dtype=float) + np.log10(np.maximum(q[each, own], 1e-30)).sum(dtype=float), len(each))
                    d1, d2 = np.empty((CLASSES, len(each))), np.empty((MEMBERS, len(each)))
                    np.negative(p.T, out=d1)
                    np.negative(q.T, out=d2)
                    d1[c[s], each] += 1
                    d2[own, each] += 1
                    held.append((one[:, s], two[:, s], d1, d2))
                    if sum(x[0].shape[1] for x in held) >= SUM:
                        add()
            if held:
                add()
            yield _packed(0, np.concatenate([sums[0].T, seen[0][:, None]], axis=1))
            yield _packed(1, np.concatenate([sums[1].T, seen[1][:, None]], axis=1))
            yield _packed(2, likelihood)

        part = dealt.where(F.col("_round") == k).select("text").coalesce(tasks)
        g1, g2, likelihood = _summed(mapped(part, gradient, "part long, blob binary"), [(rows, CLASSES + 1), (rows, MEMBERS + 1), (1, 2)])
        sent.unpersist()
        model.progress.append(float(likelihood[0, 0] / max(likelihood[0, 1], 1)))
        model.weights1 = _moved(model.weights1, prior1, g1[:, :-1], g1[:, -1], rate, smooth)
        model.weights2 = _moved(model.weights2, inner, g2[:, :-1], g2[:, -1], rate, smooth)
    return model


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """word, n of the words above a bound on n that at most ``most`` words pass; the bound is found by eighths of octaves."""
    size = F.floor(F.log2("n") * 8).cast("int")
    found, bound = 0, None
    for r in counts.groupBy(size.alias("b")).count().orderBy(F.desc("b")).collect():  # 8 * 64 rows at most
        found += r["count"]
        if found > most:
            break
        bound = r["b"]
    return counts.where(size >= bound if bound is not None else F.lit(False)).select("word", "n")


def score(docs: DataFrame, held_out=None, head: int = HEAD, model: Model | None = None, **how) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    if held_out is None:
        held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    learned = rows.where(~F.col("held_out"))
    counts = scratch.keep(word_counts(learned), "counts")
    model = model or train(learned, counts, **how)
    top = frequent(counts, head).toArrow()
    word = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    sent = spark.sparkContext.broadcast((model, word[order], top.column("n").to_numpy()[order]))
    log_all = float(np.log10(model.total + model.distinct + 1))
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word long, class int, times long"

    def run(batches):
        m, heads, head_n = sent.value
        room = m.rest + m.once + 1
        uid = TaskContext.get().partitionId() << 36
        for b, i, j, h, c, to in _spread(batches):
            n, size = j - i, len(h)
            part = m.log_factors(h, c, to)
            member = m.members(h) < MEMBERS - 1  # what is left of these is certain
            at = np.minimum(np.searchsorted(heads, h), max(len(heads) - 1, 0))
            known = heads[at] == h if len(heads) else np.zeros(size, bool)
            times = np.where(known, head_n[at] if len(heads) else 0, 0)
            doc = np.repeat(np.arange(n), np.diff(to))
            part += np.where(known & ~member, np.log10(np.maximum(times, 1) / room[c]), 0.0)
            ids = np.arange(uid, uid + n)
            uid += n
            total_of = lambda x, doc=doc, n=n: np.bincount(doc, weights=x, minlength=n)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "uid": pa.array(ids), "doc_id": b.column("doc_id").slice(i, n), "held_out": b.column("held_out").slice(i, n), "n_tokens": pa.array(np.diff(to), pa.int64()), "n_known": pa.array(total_of(known).astype(np.int64)),
                "base": pa.array(total_of(np.where(known, np.log10(times + 1.0), 0.0)) - np.diff(to) * log_all), "score": pa.array(total_of(part)), "word": none, "class": pa.nulls(n, pa.int32()), "times": none,
            })
            rare = np.flatnonzero(~known)
            if len(rare):
                order = np.lexsort((h[rare], doc[rare]))
                rare = rare[order]
                new = np.flatnonzero(np.concatenate([[True], (h[rare][1:] != h[rare][:-1]) | (doc[rare][1:] != doc[rare][:-1])]))
                k = len(new)
                none, real = pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64())
                # the class of a member is CLASSES: nothing but its count is asked for
                kind = np.where(member[rare[new]], CLASSES, c[rare[new]])
                yield pa.RecordBatch.from_pydict({
                    "uid": pa.array(ids[doc[rare[new]]]), "doc_id": none, "held_out": pa.nulls(k, pa.bool_()), "n_tokens": none, "n_known": none, "base": real, "score": real,
                    "word": pa.array(h[rare[new]].view(np.int64)), "class": pa.array(kind, pa.int32()), "times": pa.array(np.diff(np.concatenate([new, [len(rare)]])), pa.int64()),
                })

    both = scratch.keep(mapped(rows, run, schema), "scored")
    room, fresh = np.log10(model.rest + model.once + 1), np.log10((model.once + 1) / (model.rest + model.once + 1))
    of_class = lambda x: F.element_at(F.array(*[F.lit(float(v)) for v in [*x, 0.0]]), F.col("class") + 1)
    log_word = F.when(F.col("class") == CLASSES, F.lit(0.0)).when(F.col("n").isNotNull(), F.log10(F.col("n").cast("double")) - of_class(room)).otherwise(of_class(fresh))
    tail = both.where("word is not null").select("uid", "word", "class", "times").join(counts.select("word", "n"), "word", "left")
    tail = tail.groupBy("uid").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("more_base"),
        F.sum(F.col("times") * log_word).alias("more_score"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return both.where("word is null").join(tail, "uid", "left").select("doc_id", "held_out", "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score"))


def op4_maxent_scoring(docs: DataFrame) -> DataFrame:
    return score(docs)
