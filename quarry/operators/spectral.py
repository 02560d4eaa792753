"""Graph-spectral diagnostics of attention matrices and hidden states, one (row, layer) at a time.

``by_row`` has a graph for each row; ``by_group`` makes a graph of all rows of a group, whose cost is the cube of its size.

The definitions are this engine's own choices, as none are published with the data: attention is symmetrised as
(A + A') / 2 and averaged over heads; HFER is the share of signal energy above the ``cut`` quantile of the spectrum;
smoothness is tr(X'LX) / tr(X'X); spectral entropy is Shannon's of the energy by eigenvalue, in nats.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def laplacian(a: np.ndarray, kind: str = "sym") -> np.ndarray:
    a = (a + np.swapaxes(a, -1, -2)) / 2
    if a.ndim == 3:
        a = a.mean(axis=0)
    d = a.sum(axis=1)
    if kind == "comb":
        return np.diag(d) - a
    with np.errstate(divide="ignore"):
        if kind == "rw":
            return np.eye(len(a)) * (d > 0)[:, None] - np.where(d > 0, 1 / d, 0)[:, None] * a
        s = np.where(d > 0, d**-0.5, 0)
    return np.diag((d > 0).astype(float)) - s[:, None] * a * s[None, :]


def diagnostics(x: np.ndarray, lap: np.ndarray, cut: float = 0.5) -> tuple[float, float, float, float]:
    """hfer, fiedler, smoothness, entropy."""
    lap = (lap + lap.T) / 2  # frees the caller's matrix if nothing else holds it
    values, vectors = np.linalg.eigh(lap)
    del lap
    energy = ((vectors.T @ x) ** 2).sum(axis=1)
    total = energy.sum()
    if total <= 0:
        return 0.0, float(values[1]) if len(values) > 1 else 0.0, 0.0, 0.0
    share = energy / total
    some = share[share > 0]
    return float(share[int(len(values) * cut) :].sum()), float(values[1]) if len(values) > 1 else 0.0, float((share * values).sum()), float(-(some * np.log(some)).sum())


def by_group(df: DataFrame, key: str, vector: str, id_col: str, most: int | None = None, kind: str = "sym", legacy_zero: bool = False) -> DataFrame:
    """A graph of similar vectors for each group: weights max(0, cosine), signals the vectors themselves.

    A group is one graph, whole, whatever its size: a task holds its matrix of weights (8 n * n bytes, and some copies).
    Only those who give ``most`` get parts of so many vectors by id rank, without the edges between parts.
    """
    part = F.floor((F.row_number().over(Window.partitionBy(key).orderBy(id_col)) - 1) / most).cast("int") if most else F.lit(0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            x = np.stack(pdf.sort_values(id_col)[vector].to_numpy()).astype(float)
            if not np.isfinite(x).all():
                raise ValueError("values that aren't finite")
            unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            a = unit @ unit.T
            np.maximum(a, 0, out=a)
            np.fill_diagonal(a, 0)
            a = laplacian(a, kind)
            held = [a]
            del a
            got = diagnostics(x, held.pop())
        except (ValueError, np.linalg.LinAlgError):  # a failed matrix is a null, or zeros for those who ask for them
            got = (0.0,) * 4 if legacy_zero else (None,) * 4
        return pd.DataFrame([(pdf[key].iloc[0], pdf["part"].iloc[0], len(pdf), *got)], columns=["group_id", "part", "n", "hfer", "fiedler", "smoothness", "entropy"])

    return df.select(key, vector, id_col).withColumn("part", part).groupBy(key, "part").applyInPandas(run, "group_id int, part int, n long, hfer double, fiedler double, smoothness double, entropy double")


def by_row(df: DataFrame, vector: str, id_col: str, tokens: int = 8, kind: str = "sym", legacy_zero: bool = False) -> DataFrame:
    """One graph a row, its natural unit: the vector as ``tokens`` signals, weighted by their softmax attention.

    Rows are independent, so this is one pass without a shuffle.  A vector whose length ``tokens`` doesn't divide, or with
    values that aren't finite, has null diagnostics, or zeros for those who ask for them.
    """

    def run(batches):
        for b in batches:
            out = []
            for v in b[vector]:
                x = np.asarray(v, float) if v is not None else np.zeros(0)
                if not len(x) or len(x) % tokens or not np.isfinite(x).all():
                    out.append((0.0,) * 4 if legacy_zero else (None,) * 4)
                    continue
                x = x.reshape(tokens, -1)
                z = x @ x.T / np.sqrt(x.shape[1])
                a = np.exp(z - z.max(axis=1, keepdims=True))
                out.append(diagnostics(x, laplacian(a / a.sum(axis=1, keepdims=True), kind)))
            found = pd.DataFrame(out, columns=["hfer", "fiedler", "smoothness", "entropy"], dtype=float)
            yield pd.concat([b[[id_col]].reset_index(drop=True), found], axis=1)

    return df.select(id_col, vector).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, hfer double, fiedler double, smoothness double, entropy double")


def aligned(attention: DataFrame, hidden: DataFrame, keys: list[str], layer: str = "layer") -> DataFrame:
    """Attention of layer l beside the hidden states after it, those of l + 1."""
    return attention.join(hidden.withColumn(layer, F.col(layer) - 1), [*keys, layer])


def likelihood(df: DataFrame, nll: str = "nll") -> DataFrame:
    """ppl, logprob_mean, logprob_min, len_gen from an array of token losses; rows without tokens are left out."""
    n = F.size(nll)
    mean = F.aggregate(nll, F.lit(0.0), lambda a, x: a + x) / n
    return df.where(n > 0).withColumns({"ppl": F.exp(mean), "logprob_mean": -mean, "logprob_min": -F.array_max(nll), "len_gen": n})
