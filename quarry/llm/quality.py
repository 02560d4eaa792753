"""Operator 10, quality rules: rule failures by host, shrunk by an empirical beta prior and joined back.

A document fails the *base* rules if it has fewer than ``min_words`` words or if more than ``max_repeat`` percent of
its words lie in 8-word windows that the text holds twice or more.  *Soft* rules look at symbols and repeated lines; a
soft failure is *strong* above ``strong`` times a rule's limit.  For each host (by default the column ``source``) the
documents that fail any rule are counted; a beta prior fitted to the hosts' rates by moments (hosts of few documents count less) shrinks each host's rate,
so that a host of few documents can't be judged on them alone.  A host is bad if its shrunk rate, less ``host_z``
posterior deviations, has more than ``host_odds`` times the odds of the prior's mean: hosts are judged against each
other.  A document is rejected if it fails a base rule, if it fails a soft rule strongly, or if it fails a soft rule and
its host is bad: clean documents of a bad host stay.

Edge cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; repeated rows
are judged each by itself; an empty table gives an empty table; other columns are not read and don't clash, because
only ``doc_id``, the host and the text are taken; the texts are read once, and the counts written before hosts are judged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import text as tx
from quarry.llm.scratch import Scratch, mapped

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat: int = 30  # percent of words in repeated windows
    window: int = 8
    soft_symbols: float = 0.1  # of the words' characters
    soft_lines: float = 0.3  # repeated lines against lines
    strong: float = 2.0  # times a soft limit, beyond which any host's document is rejected
    host_odds: float = 2.0  # a bad host's odds of a failure against those of the prior's mean
    host_docs: float = 20.0  # a host of so many documents counts half of a large one for the prior
    host_z: float = 2.0  # posterior deviations by which a bad host is beyond them


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def measure(data: np.ndarray, off: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """The counts of each document: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    n = len(off) - 1
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    if not len(data):
        return {k: np.zeros(n, np.int64) for k in names}
    start, end, wo = tx.words(data, off)
    sums = tx.prefix_hash(data)
    n_words = np.diff(wo)
    chars = tx.grouped_sum(~tx.SPACE[data] & ((data & 0xC0) != 0x80), off)
    symbols = tx.grouped_sum(_SYMBOL[data], off)

    # lines: runs between newlines and the documents' ends; the first of equal lines of a document is no repeat
    newline = np.flatnonzero(data == 10)
    owner = np.searchsorted(off, newline, "right") - 1
    ls = np.concatenate([off[:-1], newline + 1])
    le = np.concatenate([newline, off[1:]])
    lo = np.concatenate([np.arange(n), owner])
    # an empty document's line starts and ends where its neighbour's does; sorting pairs starts and ends in order
    order = np.lexsort((lo, ls))
    ls, lo, le = ls[order], lo[order], np.sort(le)
    solid = np.concatenate([np.zeros(1, np.int64), np.cumsum(~tx.SPACE[data])])
    has = solid[le] > solid[ls]
    ls, le, lo = ls[has], le[has], lo[has]
    n_lines = np.bincount(lo, minlength=n)
    lh = tx.span_hash(sums, ls, le)
    order = np.lexsort((lh, lo))
    same = np.zeros(len(order), bool)
    same[1:] = (lh[order][1:] == lh[order][:-1]) & (lo[order][1:] == lo[order][:-1])
    n_dup = np.bincount(lo[order][same], minlength=n)

    # words under windows that occur twice or more
    word = tx.span_hash(sums, start, end)
    doc = np.repeat(np.arange(n), n_words)
    full = tx.window_hash(word, window)
    at = np.flatnonzero(wo[doc[: len(full)] + 1] - np.arange(len(full)) >= window) if len(full) else np.zeros(0, np.int64)
    h, o = full[at], doc[at]
    order = np.lexsort((h, o))
    eq = (h[order][1:] == h[order][:-1]) & (o[order][1:] == o[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= eq
    twice[:-1] |= eq
    hits = at[order[twice]]
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, hits, 1)
    np.subtract.at(cover, hits + window, 1)
    repeat = tx.grouped_sum(np.cumsum(cover)[:-1] > 0, wo) if len(word) else np.zeros(n, np.int64)
    return dict(zip(names, (n_words, chars, symbols, n_lines, n_dup, repeat), strict=True))


def counts(docs: DataFrame, host: str = "source", window: int = 8, carry: bool = False) -> DataFrame:
    """doc_id, host and the counts of ``measure`` for every document; with ``carry`` also its whole row, as ``doc``."""
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for b in batches:
            data, off = tx.utf8(pc.struct_field(b.column("doc"), "text") if carry else b.column("text"))
            got = [measure(data[off[i] : off[j]], off[i : j + 1] - off[i], window) for i, j in tx.slices(off)]
            cols = {k: pa.array(np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64), pa.int64()) for k in names}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "host": b.column("host"), **cols} | ({"doc": b.column("doc")} if carry else {}))

    whole = F.struct(*docs.columns).alias("doc")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), whole if carry else F.col("text"))
    more = ", doc " + docs.select(whole).schema["doc"].dataType.simpleString() if carry else ""
    return mapped(picked, run, "doc_id long, host string, " + ", ".join(f"{k} long" for k in names) + more)


def judged(counted: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds base_failed, soft_failed, strong_failed, host_rate (shrunk), host_bad and kept to the rows of ``counts``.

    The hosts' failures are summed before the shuffle, and what is joined back has a row for each host.
    """
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat * F.col("n_words"))

    def soft(times: float) -> Column:
        return (F.col("n_symbols") > times * rules.soft_symbols * F.col("word_chars")) | (F.col("n_dup_lines") > times * rules.soft_lines * F.col("n_lines"))

    rows = counted.withColumns({"base_failed": base, "soft_failed": soft(1.0), "strong_failed": soft(rules.strong)})
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("failed"))
    rate = F.try_divide(F.col("failed").cast("double"), F.col("n"))
    # moments over hosts, those of few documents counting less: mean m and variance v of the rates give the prior's
    # weight m (1 - m) / v - 1
    share = F.col("n") / (F.col("n") + rules.host_docs)
    sums = hosts.agg(F.sum(share).alias("s"), F.sum(share * rate).alias("r"), F.sum(share * rate * rate).alias("q"))
    mean = F.try_divide("r", "s")
    prior = sums.select(mean.alias("m"), F.greatest(F.try_divide("q", "s") - mean * mean, F.lit(0.0)).alias("v")).select(
        F.coalesce("m", F.lit(0.0)).alias("m"),
        F.least(F.greatest(F.coalesce(F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1, F.lit(1e6)), F.lit(1.0)), F.lit(1e6)).alias("weight"),
    )
    shrunk = hosts.crossJoin(F.broadcast(prior)).withColumn("host_rate", (F.col("failed") + F.col("m") * F.col("weight")) / (F.col("n") + F.col("weight")))
    low = F.col("host_rate") - rules.host_z * F.sqrt(F.greatest(F.col("host_rate") * (1 - F.col("host_rate")), F.lit(0.0)) / (F.col("n") + F.col("weight") + 1))
    # odds against odds without a division: low / (1 - low) > host_odds * m / (1 - m)
    shrunk = shrunk.select(F.col("host").alias("_host"), "host_rate", (low * (1 - F.col("m")) > rules.host_odds * F.col("m") * (1 - low)).alias("host_bad"))
    return (
        rows.join(shrunk, F.col("host").eqNullSafe(F.col("_host")), "left")
        .drop("_host")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("strong_failed") & ~(F.col("soft_failed") & F.coalesce("host_bad", F.lit(False))))
    )


def quality_rules(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    counted = Scratch(docs.sparkSession).keep(counts(docs, host, rules.window), "counts")
    return judged(counted, rules)


def kept(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep; each row carries its own verdict, so ids may repeat or lack."""
    counted = Scratch(docs.sparkSession).keep(counts(docs, host, rules.window, carry=True), "counts")
    return judged(counted, rules).where("kept").select("doc.*")


def op10_quality_rules(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))
