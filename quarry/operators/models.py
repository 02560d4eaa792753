"""Logistic-regression detectors and searches over feature combinations.

One detector is fitted on any number of rows: a Newton step's sums are made in tasks and only they, features x features
numbers a partition, come together.  A search fits very many detectors on a small study (about a thousand rows and tens of
pooled features), so there the matrix is broadcast, checked against MAX_CELLS, and combinations are what is distributed:
numbers of a range, turned into combinations in the tasks.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import curves, effects, joins, sampling

MAX_CELLS = 20_000_000


def area(y: np.ndarray, s: np.ndarray) -> float:
    ranks = pd.Series(s).rank().to_numpy()
    p = int(y.sum())
    n = len(y) - p
    return float((ranks[y == 1].sum() - p * (p + 1) / 2) / (p * n)) if p and n else 0.5


def newton(x: np.ndarray, y: np.ndarray, c: float = 1.0, penalise_intercept: bool = False, balanced: bool = False, rounds: int = 100) -> np.ndarray:
    """Coefficients and intercept that minimise |w|^2 / 2 + C * log-loss; the intercept is penalised on demand."""
    x1 = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (len(y) - y.sum()), 1)) if balanced else np.ones(len(y))
    pull = np.ones(x1.shape[1])
    pull[-1] = float(penalise_intercept)
    loss = lambda w: 0.5 * (pull * w * w).sum() + c * (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (x1 @ w))).sum()
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -500, 500)))
        grad = pull * w + c * x1.T @ (weight * (p - y))
        hess = np.diag(pull + 1e-12) + c * (x1 * (weight * p * (1 - p))[:, None]).T @ x1
        step, size, now = np.linalg.solve(hess, grad), 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-8:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-10:
            break
    return w


def wide(long: DataFrame, features: list[str]) -> DataFrame:
    """row_id, y and a column for each feature; missing values are 0."""
    return long.where(F.col("feature").isin(features)).groupBy("row_id", "y").pivot("feature", features).agg(F.first("value")).na.fill(0.0)


def matrix(long: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and the feature matrix of a small study."""
    table = wide(long, features)
    if table.count() * len(features) > MAX_CELLS:
        raise ValueError("too many cells for a broadcast matrix; sample rows or pool fewer features")
    got = table.orderBy("row_id").toPandas()
    return got["row_id"].to_numpy(), got["y"].to_numpy(), got[features].to_numpy(float)


def fit(long: DataFrame, features: list[str], c: float = 1.0, penalise_intercept: bool = False, balanced: bool = False, rounds: int = 30, tolerance: float = 1e-9) -> np.ndarray:
    """``newton`` on any number of rows: each round is a job that gives loss, gradient and Hessian, summed over partitions."""
    table = wide(long, features).select("y", *features)
    count = {int(r["y"]): r["count"] for r in table.groupBy("y").count().collect()}
    total = sum(count.values())
    share = {k: total / (2 * count[k]) if balanced else 1.0 for k in count}
    k = len(features) + 1
    pull = np.ones(k)
    pull[-1] = float(penalise_intercept)

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(1 + k + k * k)
            for b in batches:
                y = b["y"].to_numpy(float)
                x = np.column_stack([b[features].to_numpy(float), np.ones(len(b))])
                weight = np.where(y == 1, share.get(1, 1.0), share.get(0, 1.0))
                z = x @ w
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                out[0] += (weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum()
                out[1 : k + 1] += x.T @ (weight * (p - y))
                out[k + 1 :] += ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()
            yield pd.DataFrame({"place": np.arange(len(out)), "part": out})

        got = table.mapInPandas(part, "place int, part double").groupBy("place").agg(F.sum("part").alias("s")).orderBy("place").collect()
        s = np.array([r["s"] for r in got]) if got else np.zeros(1 + k + k * k)
        return c * s[0] + 0.5 * (pull * w * w).sum(), pull * w + c * s[1 : k + 1], np.diag(pull + 1e-12) + c * s[k + 1 :].reshape(k, k)

    w = np.zeros(k)
    now, grad, hess = sums(w)
    for _ in range(rounds):
        step, size = np.linalg.solve(hess, grad), 1.0
        if np.abs(step).max() < tolerance:
            break
        new = sums(w - step)
        while new[0] > now + 1e-12 * abs(now) and size > 1e-6:
            size /= 2
            new = sums(w - size * step)
        w, (now, grad, hess) = w - size * step, new
    return w


def scored(long: DataFrame, features: list[str], w: np.ndarray) -> DataFrame:
    """row_id, y, value: the probability that coefficients and intercept ``w`` give; expressions only."""
    z = sum((F.col(f"`{f}`") * float(x) for f, x in zip(features, w[:-1], strict=True)), F.lit(float(w[-1])))
    return wide(long, features).select("row_id", "y", (1 / (1 + F.exp(-z))).alias("value"))


def assigned_folds(ids: np.ndarray, y: np.ndarray, folds: int, seed: int = 42) -> np.ndarray:
    """The folds that ``sampling.folds`` deals: by class, in the order of a hash of id and seed."""
    order = sorted(range(len(ids)), key=lambda i: (y[i], hashlib.md5(f"{ids[i]}|{seed}".encode()).hexdigest(), ids[i]))
    fold, seen = np.zeros(len(ids), int), {0: 0, 1: 0}
    for i in order:
        fold[i] = seen[int(y[i])] % max(folds, 1)
        seen[int(y[i])] += 1
    return fold


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int, penalise_intercept: bool, balanced: bool) -> np.ndarray:
    """Log-odds of each row by a fit on the other folds; with ``folds`` 0 by a fit on all rows."""
    score = np.zeros(len(y))
    for k in range(max(folds, 1)):
        test = fold == k
        w = newton(x[~test] if folds else x, y[~test] if folds else y, 1.0, penalise_intercept, balanced)
        score[test] = np.column_stack([x[test], np.ones(test.sum())]) @ w
    return score


def _standard(x: np.ndarray) -> np.ndarray:
    s = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(s > 0, s, 1)


def unranked(number: int, n: int, size: int) -> tuple[int, ...]:
    """Combination ``number`` of ``size`` places out of n, in lexicographic order."""
    out, at = [], 0
    for left in range(size, 0, -1):
        while (block := math.comb(n - at - 1, left - 1)) <= number:
            number -= block
            at += 1
        out.append(at)
        at += 1
    return tuple(out)


def search(long: DataFrame, pools: dict[int, list[str]], folds: int | None = 5, scaled: bool = True, penalise_intercept: bool = True, balanced: bool = False, keep=None, seed: int = 42) -> DataFrame:
    """features, n_features, auc of every combination: size -> its pool.  ``folds`` 0 scores the rows it is fitted on; None
    takes the folds of small studies.

    keep: a predicate on combinations (anchored and banded searches).
    """
    spark = long.sparkSession
    names = sorted({f for pool in pools.values() for f in pool})
    ids, y, x = matrix(long, names)
    if scaled:
        x = _standard(x)
    if folds is None:
        folds = sampling.few_folds(int(y.sum()))
    fold, k_folds = assigned_folds(ids, y, folds, seed), folds
    sent = spark.sparkContext.broadcast((x, y, fold))
    place = {f: i for i, f in enumerate(names)}
    sizes = [(size, pool, math.comb(len(pool), size)) for size, pool in pools.items()]
    total = sum(n for _, _, n in sizes)

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, fold = sent.value
        for b in batches:
            rows = []
            for number in b["id"].tolist():
                for size, pool, n in sizes:
                    if number < n:
                        break
                    number -= n
                f = [pool[i] for i in unranked(number, len(pool), size)]
                if keep is None or keep(tuple(f)):
                    rows.append((f, size, area(y, out_of_fold(x[:, [place[i] for i in f]], y, fold, k_folds, penalise_intercept, balanced))))
            yield pd.DataFrame(rows, columns=["features", "n_features", "auc"]).astype({"n_features": "int32", "auc": "float64"})

    numbers = spark.range(0, total, 1, max(1, min(total // 50, 4096)))
    return numbers.mapInPandas(fits, "features array<string>, n_features int, auc double")


def greedy(long: DataFrame, pool: list[str], most: int = 5) -> DataFrame:
    """Forward selection by in-sample area; one job a step, ends when nothing gains."""
    spark, chosen, best, rows = long.sparkSession, [], 0.0, []
    while len(chosen) < most:
        step = [f for f in pool if f not in chosen]
        if not step:
            break
        found = search(long, {len(chosen) + 1: [*chosen, *step]}, folds=0, keep=lambda c, had=tuple(chosen): set(had) <= set(c)).orderBy(F.desc("auc"), "features").first()
        if found["auc"] <= best:
            break
        best, chosen = found["auc"], [*chosen, *[f for f in found["features"] if f not in chosen]]
        rows.append((len(chosen), list(chosen), best))
    return spark.createDataFrame(rows, "step int, features array<string>, auc double")


def anchored(long: DataFrame, anchor: str, others: list[str], partners: int = 5, **how) -> DataFrame:
    """The anchor alone, with each other feature, and with pairs of its ``partners`` best ones; in-sample, unscaled by default."""
    how = {"folds": 0, "scaled": False, "penalise_intercept": False} | how
    alone = search(long, {1: [anchor]}, **how)
    pairs = search(long, {2: [anchor, *others]}, keep=lambda c: anchor in c, **how)
    best = [r["f"] for r in pairs.select(F.element_at(F.array_except("features", F.array(F.lit(anchor))), 1).alias("f"), "auc").orderBy(F.desc("auc"), "f").limit(partners).collect()]
    triples = search(long, {3: [anchor, *best]}, keep=lambda c: anchor in c, **how)
    return alone.unionByName(pairs).unionByName(triples)


def per_domain(long: DataFrame, domain: str, features: list[str], rows: int = 20, positives: int = 5, first: int = 10, second: int = 15) -> DataFrame:
    """The best single feature and the best pair of each domain with enough rows: pairs of its first ranks, fitted in-sample.

    Singles of all domains are one plan; a domain's pairs are a search of its own.
    """
    spark = long.sparkSession
    counts = long.where(F.col("feature") == features[0]).groupBy(domain).agg(F.count("*").alias("n"), F.sum("y").alias("p")).where((F.col("n") >= rows) & (F.col("p") >= positives) & (F.col("n") > F.col("p")))
    good = [r[0] for r in counts.select(domain).orderBy(domain).collect()]
    singles = curves.directed(long.where(F.col(domain).isin(good) & F.col("feature").isin(features)), [domain, "feature"])
    top = singles.withColumn("rank", F.row_number().over(Window.partitionBy(domain).orderBy(F.desc("auc"), "feature"))).where(F.col("rank") <= second).select(domain, "feature", "auc", "rank").collect()
    out = [(d, [r["feature"]], 1, r["auc"]) for d in good for r in top if r[domain] == d and r["rank"] == 1]
    for d in good:
        pool = [r["feature"] for r in sorted((r for r in top if r[domain] == d), key=lambda r: r["rank"])]
        if len(pool) < 2:
            continue
        lead = set(pool[:first])
        found = search(long.where(F.col(domain) == d), {2: pool}, folds=0, scaled=False, penalise_intercept=False, keep=lambda c, lead=lead: bool(lead & set(c))).orderBy(F.desc("auc"), "features").first()
        out.append((d, found["features"], 2, found["auc"]))
    return spark.createDataFrame(out, f"{domain} string, features array<string>, n_features int, auc double")


def cross_scores(long: DataFrame, configs: dict[str, list[str]], folds: int | None = None, seed: int = 42) -> DataFrame:
    """config, row_id, y, value: out-of-fold probabilities of each configuration whose features the table has."""
    spark = long.sparkSession
    names = sorted({f for fs in configs.values() for f in fs})
    table = spark.createDataFrame([(k, v) for k, v in configs.items()], "config string, features array<string>")
    known = {r["config"] for r in joins.with_known_features(table, long).select("config").collect()}
    ids, y, x = matrix(long, names)
    k = sampling.few_folds(int(y.sum())) if folds is None else folds
    sent = spark.sparkContext.broadcast((ids, y, _standard(x), assigned_folds(ids, y, k, seed)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, y, x, fold = sent.value
        for b in batches:
            for config, fs in zip(b["config"], b["features"], strict=True):
                z = out_of_fold(x[:, [names.index(f) for f in fs]], y, fold, k, True, False)
                yield pd.DataFrame({"config": config, "row_id": ids, "y": y, "value": 1 / (1 + np.exp(-np.clip(z, -500, 500)))})

    return table.where(F.col("config").isin(sorted(known))).repartition(max(1, len(known)), "config").mapInPandas(run, "config string, row_id long, y int, value double")


def verified(long: DataFrame, configs: dict[str, list[str]], passing: float = 0.85) -> DataFrame:
    """Named detectors by out-of-fold scores: area, Youden's point and its rates, and whether the area passes."""
    scores = cross_scores(long, configs)
    areas = curves.auc(scores, ["config"]).select("config", "auc")
    points = curves.best(scores, ["config"]).select("config", "threshold", "tp", "fp", (F.col("pos") - F.col("tp")).alias("fn"), (F.col("neg") - F.col("fp")).alias("tn"), "precision", F.col("tpr").alias("recall"), "f1", "balanced")
    return areas.join(points, "config").withColumn("passed", F.col("auc") > passing)


def calibrated(a: DataFrame, b: DataFrame, features: list[str], **how) -> DataFrame:
    """A detector fitted and its threshold set on ``a``, then applied to ``b``: one row with both areas and b's confusion."""
    w = fit(a, features, **how)
    one, two = (scored(x, features, w).withColumn("k", F.lit(0)) for x in (a, b))
    area_of = lambda x, name: curves.auc(x, ["k"]).select("k", F.col("auc").alias(name))
    threshold = curves.best(one, ["k"]).select("k", "threshold")
    points = curves.confusion(two, ["k"], threshold).select("k", "tp", "fp", "fn", "tn", "precision", F.col("tpr").alias("recall"), "specificity", "fpr", "balanced")
    out = area_of(one, "auc_calibration").join(area_of(two, "auc_validation"), "k").join(threshold, "k").join(points, "k")
    return out.withColumn("gap", F.col("auc_calibration") - F.col("auc_validation")).withColumn("verdict", effects.gap_verdict()).drop("k")


def efficiency(long: DataFrame, pool: list[str], golden: dict[int, list[str]], sizes: tuple[int, ...] = (10, 20, 30, 40, 50, 75, 100, 150), trials: int = 20, top: int = 15, seed: int = 42) -> DataFrame:
    """n, trials of two classes, and for each number of features how often a seeded sample of n rows leads to its golden set.

    A trial ranks single features in its sample and fits all combinations of the ``top`` ones; trials are dealt to tasks.
    """
    spark = long.sparkSession
    sent = spark.sparkContext.broadcast(matrix(long, pool))
    grid = spark.createDataFrame([(n, t) for n in sizes for t in range(trials)], "n int, trial int").repartition(max(1, min(len(sizes) * trials, 4096)))

    def best(x: np.ndarray, y: np.ndarray, k: int) -> set[int]:
        fitted = lambda c: area(y, out_of_fold(x[:, list(c)], y, np.zeros(len(y), int), 0, True, False))
        ranked = sorted(range(x.shape[1]), key=lambda i: -fitted([i]))
        if k == 1:
            return {ranked[0]}
        return set(max(itertools.combinations(ranked[:top], k), key=fitted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, y, x = sent.value
        for b in batches:
            rows = []
            for n, t in zip(b["n"], b["trial"], strict=True):
                order = sorted(range(len(ids)), key=lambda i: hashlib.md5(f"{ids[i]}|{seed}|{n}|{t}".encode()).hexdigest())[: int(n)]
                if len(set(y[order].tolist())) < 2:
                    continue
                own = _standard(x[order])
                rows += [(n, t, k, {pool[i] for i in best(own, y[order], k)} == set(want)) for k, want in golden.items()]
            yield pd.DataFrame(rows, columns=["n", "trial", "k", "hit"]).astype({"n": "int32", "trial": "int32", "k": "int32", "hit": "bool"})

    found = grid.mapInPandas(run, "n int, trial int, k int, hit boolean")
    return found.groupBy("n").agg(F.countDistinct("trial").alias("valid_trials"), *[(100.0 * F.avg(F.when(F.col("k") == k, F.col("hit").cast("int")))).alias(f"percent_{k}") for k in golden])


def coefficients(long: DataFrame, features: list[str], **how) -> DataFrame:
    w = fit(long, features, **how)
    return long.sparkSession.createDataFrame([*zip([*features, "intercept"], map(float, w), strict=True)], "term string, coefficient double")


def ranked(results: DataFrame, per: list[str], objective: str = "auc", top: int = 1) -> DataFrame:
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(F.desc(objective), "features"))).where(F.col("rank") <= top)


