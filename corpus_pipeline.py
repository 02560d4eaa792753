"""A corpus from raw documents to token counts: quality, near copies, repeated passages, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again as the next one's
docs.  All but the last return the columns of ``documents``.

Edge cases: a stage's decision about a document holds for all rows that equal it in doc_id and text; rows without doc_id
are documents like others; different texts under one doc_id are judged and linked each by itself, while repeated passages
and the mixture take them as the operators do (one document; a draw of its own for each row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, jaccard, mixing, quality, repeats
from quarry.llm.scratch import Scratch, documents


def _stage(f):
    """A stage's intermediate tables go when the next one of the same application and table starts: its result has been
    written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        made = _made.setdefault((spark.sparkContext.applicationId, sf_dir), [])
        while made:
            made.pop().clear()
        Scratch.opened.append(made)
        try:
            return f(docs)
        finally:
            Scratch.opened.remove(made)

    return run


#: Folders of the last stage that ran, by application and table.
_made: dict[tuple[str, str], list[Scratch]] = {}


@_stage
def quality_rules(docs: DataFrame) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.kept(docs)


@_stage
def near_copies(docs: DataFrame) -> DataFrame:
    """Of each component of near copies the document of smallest doc_id stays."""
    return jaccard.one_of_each(docs)


@_stage
def repeated_passages(docs: DataFrame) -> DataFrame:
    """Bytes under 100-byte strings that start earlier go, and documents of which nothing is left."""
    cut = repeats.remove(docs, repeats.repeated_spans(docs), docs.columns)
    return cut.where(F.length("text") > 0).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def mixture(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.taken(docs)


@_stage
def encoding(docs: DataFrame) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes."""
    return bpe.op8_byte_bpe(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_copies),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixture),
    ("byte_bpe", encoding),
]

#: SQL can't express the first, third and last stage; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
