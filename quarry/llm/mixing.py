"""Operator 9, mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Sources in code point order, null last, get the weights 5, 2, 1 in turn and share all words of the corpus; a source's
target stops at ``most`` times its own words and the rest is shared anew by weight.  That fixed point is found in closed
form: with sources ordered by cap / weight, those before the first whose cap exceeds its share are at their caps.
A source gives whole epochs first.  What is left of its target is filled by documents in the order of exponential keys
-ln(u) / quality, u from a hash of doc_id and seed, so that reruns agree; keys are cut into BINS ranges per source
whose words are summed first, and documents are ranked only inside a range, so no task sorts a source.  Only
documents that end within the budget are taken.  Those that don't fit must not shut out what comes after them: the gap
that is left is offered, in key order and by the same sums, to the documents not yet selected that fit it, again and
again until none does.  Each round selects one document at least in every source that has a fitting one.
Windows over sources hold a row for each source, in one task: they suit as many sources as a task can hold rows.

Edge cases: a null or empty text has size 0 and takes 0 words; a null source is the last source; repeated rows are
documents each in the draw; if no text has words all targets are 0; an empty
table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of sampling keys in each source.
BINS = 2048


#: Characters that prose has few of.
RARE = "0123456789#*$%&|<>{}[]^~_=+@/"


def default_quality(text: Column, size: Column) -> Column:
    """The squared share of characters that prose is made of, halved where words are under 2 or over 16 characters on
    average; between 0.02 and 1."""
    mean = F.try_divide(F.length(text).cast("double"), size)
    plain = F.coalesce(F.try_divide(F.length(F.translate(text, RARE, "")).cast("double"), F.length(text)), F.lit(1.0))
    return F.greatest(plain * plain, F.lit(0.04)) * F.when(mean.between(2.0, 16.0), F.lit(1.0)).otherwise(F.lit(0.5))


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """source, source_size -> source, source_size, target.  One row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("weight", F.element_at(turn, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    ahead = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = F.try_divide(
        F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0)),
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)),
    )
    # the level of the first source whose cap isn't reached holds for all after it
    levels = weighed.withColumn("level", level).withColumn("free", F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "level")))
    first = F.min("free").over(everything)["level"]
    return levels.select("source", "source_size", F.when(F.col("cap") > first * F.col("weight"), first * F.col("weight")).otherwise(F.col("cap")).cast("double").alias("target"))


def identity() -> list[Column]:
    """Two hashes of doc_id, text and source that rows share only if these are equal, nulls included."""
    names = ("doc_id", "text", "source")
    whole = [F.col("doc_id").cast("long"), F.col("text"), F.col("source").cast("string"), *[F.col(c).isNull() for c in names]]
    return [F.xxhash64(F.lit(k), *whole).alias(f"k{k}") for k in (1, 2)]


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 42, quality=default_quality, bins: int = BINS) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, picked and taken = (epochs + picked) * size for every row; k1 and
    k2 are the row's ``identity``."""
    keep = Scratch(docs.sparkSession)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    rows = docs.select(*identity(), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.col("text").alias("_text"))
    keyed = rows.withColumn("key", -F.log(u) / quality(F.col("_text"), F.col("size"))).drop("_text")
    keyed = keep.keep(keyed.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * bins), F.lit(bins - 1)).cast("int")), "keyed")

    ranges = keep.keep(keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "ranges")
    aims = targets(ranges.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, most)
    # targets are whole multiples only at the cap; there the division must not fall below it
    epochs = F.least(F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)) + 1e-12), F.lit(int(most))).cast("long")
    aims = aims.withColumn("epochs", epochs).withColumn("budget", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    aims = keep.keep(aims.withColumnRenamed("source", "_source"), "aims")
    same = F.col("source").eqNullSafe(F.col("_source"))

    cols = ["k1", "k2", "doc_id", "source", "size", "source_size", "target", "epochs", "key", "bin"]
    todo, budgets, done, k = keyed.join(aims, same).drop("_source"), aims.select("_source", F.col("budget").alias("_budget")), [], 0
    while True:
        drawn = keep.keep(_draw(todo, budgets, ranges), f"drawn{k}").select(*cols, "budget", "picked")
        gaps = drawn.groupBy("source").agg((F.first("budget") - F.sum(F.col("picked") * F.col("size"))).alias("_gap")).withColumnRenamed("source", "_source")
        gaps = keep.keep(gaps, f"gaps{k}")
        fits = (F.col("picked") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("_gap"))
        offered = drawn.join(gaps, same).drop("_source").withColumn("_fits", F.coalesce(fits, F.lit(False)))
        todo = offered.where("_fits").select(*cols, F.col("_gap").alias("budget"))
        ranges = keep.keep(todo.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), f"ranges{k}")
        budgets = gaps.withColumnRenamed("_gap", "_budget")
        done.append(offered.where("not _fits").select(*cols, "picked"))
        if ranges.isEmpty():
            break
        k += 1
    return reduce(DataFrame.unionByName, done).select("k1", "k2", "doc_id", "source", "size", "source_size", "target", "epochs", "picked", ((F.col("epochs") + F.col("picked")) * F.col("size")).alias("taken"))


def taken(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken.

    Rows that are equal in doc_id, text and source stand for each other: together they are there as often as ``mix`` takes
    them.
    """
    times = mix(docs, **how).groupBy("k1", "k2").agg(F.sum(F.col("epochs") + F.col("picked")).cast("int").alias("times"), F.count("*").alias("rows")).where("times > 0")
    times = Scratch(docs.sparkSession).keep(times, "times")
    whole = docs.select(F.struct(*docs.columns).alias("doc"), *identity())
    single = whole.join(times.where("rows = 1"), ["k1", "k2"])
    several = whole.join(times.where("rows > 1"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return single.unionByName(several).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def _draw(rows: DataFrame, budgets: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds picked: 1 for rows that end within their source's budget in key order.  ranges: the words of each range of keys."""
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(before), F.lit(0))).join(budgets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # a range that ends within the budget is taken whole, one that starts beyond it not at all; at most one is between
    whole = starts.select(F.col("source").alias("_source"), F.col("bin").alias("_bin"), "bin_start", (F.col("bin_start") + F.col("bin_size") <= F.col("_budget")).alias("_whole"), (F.col("bin_start") < F.col("_budget")).alias("_begun"))
    placed = rows.join(whole, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bin") == F.col("_bin"))).drop("_source", "_bin")
    edge = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.where(F.col("_begun") & ~F.col("_whole"))
    ranked = inside.withColumn("_before", F.col("bin_start") + F.coalesce(F.sum("size").over(edge), F.lit(0)))
    ranked = ranked.withColumn("picked", (F.col("_before") + F.col("size") <= F.col("budget")).cast("long"))
    settled = placed.where(~F.col("_begun") | F.col("_whole")).withColumns({"_before": F.lit(0).cast("long"), "picked": F.col("_whole").cast("long")})
    return settled.unionByName(ranked)


def op9_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "picked")
