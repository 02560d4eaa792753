"""Operator 6, quotation linking: quoted passages lead a message to the one it answers.

A line's quote level is the number of > marks, with spaces between, at its start.  Lines of one level in a row form a
quoted passage; lines of level 0 are the message's own.  Passages and own texts are cut alike, into the whole, paragraphs,
lines and sentences (of paragraphs, so that other line breaks don't matter), normalised (lower case, runs of white space
as one blank, marks and ends trimmed) and hashed.  The first writer of each
hash, in its conversation and overall, is found by minima, so a passage of a million messages is one row there.  A
message answers the first writer in its own conversation if that is an earlier turn, else the first writer overall if
that is another message that comes before it by (conv_id, turn); of its passages the one of lowest level, then first,
that finds a writer decides, by its longest part that finds one: a passage of some paragraphs, lines or sentences of a
longer message leads there too.  Passages that very many messages quote are joined by broadcast, as there are few of them.
Roots and depths follow by pointer doubling, as many rounds as the logarithm of the longest chain; a message that has come
to its root takes no further part, so that what is joined isn't many rows of one root.  Sorted by root, depth, conv_id and turn, every message stands after what it answers: ``threads`` gives them
so, without quotes.

Edge cases: a null or empty text quotes nothing and is written by nobody; messages with equal (conv_id, turn) are one
node and keep a row each; null keys are never linked; passages and parts under MIN_CHARS normalised characters don't link; an empty
table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import Scratch, join_spread, mapped

MIN_CHARS = 12
MARK = re.compile(r"^(?:[ \t]*>)+[ \t]?")
PARAGRAPH = re.compile(r"\n[ \t]*\n")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
BLANK = re.compile(r"\s+")


def normal(text: str) -> str:
    return BLANK.sub(" ", text).strip(" \t>-*\"'").lower()


def _hash(text: str) -> int | None:
    text = normal(text)
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True) if len(text) >= MIN_CHARS else None


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and its quoted passages with their levels."""
    own, passages, level, run = [], [], 0, []
    for line in text.split("\n"):
        m = MARK.match(line)
        now = m[0].count(">") if m else 0
        if now != level and run:
            passages.append((level, "\n".join(run)))
            run = []
        level = now
        if now:
            run.append(line[m.end() :])
        else:
            own.append(line)
    if run:
        passages.append((level, "\n".join(run)))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if passages else text, passages


def parts(text: str) -> list[str]:
    """The text, its paragraphs, lines and sentences, the longest first when normalised, then in order."""
    paragraphs = PARAGRAPH.split(text)
    found = [text, *paragraphs, *text.split("\n"), *(s for p in paragraphs for s in SENTENCE.split(p))]
    return sorted(dict.fromkeys(found), key=lambda x: -len(normal(x)))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, clean, n_quotes, quote_level, quotes (hashes in order), written (hashes) of each message."""
    schema = "conv_id long, turn long, role string, clean string, n_quotes int, quote_level int, quotes array<long>, written array<long>"

    def run(batches):
        for b in batches:
            out = []
            for text in b.column("text"):
                clean, passages = parse(text.as_py() or "")
                found = [h for h in dict.fromkeys(_hash(x) for _, p in sorted(passages, key=lambda x: x[0]) for x in parts(p)) if h is not None]
                own = {_hash(x) for x in parts(clean)} - {None} if clean else set()
                out.append((clean if text.is_valid else None, len(passages), max((level for level, _ in passages), default=0), found, sorted(own)))
            c, n, q, f, w = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_pydict({"conv_id": b.column("conv_id"), "turn": b.column("turn"), "role": b.column("role"), "clean": pa.array(c, pa.string()), "n_quotes": pa.array(n, pa.int32()), "quote_level": pa.array(q, pa.int32()), "quotes": pa.array(f, pa.list_(pa.int64())), "written": pa.array(w, pa.list_(pa.int64()))})

    return mapped(messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"), run, schema)


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, clean, n_quotes, quote_level, parent_conv, parent_turn, root_conv, root_turn, depth."""
    scratch = Scratch(messages.sparkSession)
    rows = scratch.keep(parsed(messages), "parsed")
    quotes = rows.where(F.size("quotes") > 0).select("conv_id", "turn", F.posexplode("quotes").alias("order", "hash"))
    wanted = quotes.select("hash").distinct()
    written = rows.select("conv_id", "turn", F.explode("written").alias("hash")).join(wanted, "hash", "left_semi").where("conv_id is not null and turn is not null")
    here = written.groupBy("hash", "conv_id").agg(F.min("turn").alias("here"))
    anywhere = written.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    me = F.struct("conv_id", "turn")
    node = F.struct("conv_id", F.col("here").alias("turn"))
    of = lambda keys: quotes.where("hash is not null").groupBy(*keys).agg(F.count("*").alias("size"))
    near = join_spread(quotes, here, ["hash", "conv_id"], of(["hash", "conv_id"]), scratch, "near").where("here < turn").select("conv_id", "turn", "order", F.lit(0).alias("far"), node.alias("target"))
    away = join_spread(quotes, anywhere, ["hash"], of(["hash"]), scratch, "away").where(F.col("first") < me).select("conv_id", "turn", "order", F.lit(1).alias("far"), F.col("first").alias("target"))
    found = near.unionByName(away).groupBy("conv_id", "turn").agg(F.min(F.struct("order", "far", "target"))["target"].alias("parent"))
    parents = scratch.keep(found, "parents")

    # up: the ancestor 2**k links away; a link leads to an earlier message, so there are no cycles
    up = parents.select(F.struct("conv_id", "turn").alias("node"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"))
    children = parents.select(F.struct("conv_id", "turn").alias("up")).withColumn("child", F.lit(True))
    state = lambda df: df.join(children, "up", "left").select("node", "up", "depth", F.col("child").isNotNull().alias("open"))
    up, k = scratch.keep(state(up), "up0"), 0
    while up.where("open").limit(1).count():
        above = up.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("open").alias("on"))
        step = up.where("open").join(above, "up").select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("on").alias("open"))
        k += 1
        up = scratch.keep(up.where("not open").unionByName(step), f"up{k}")
    tops = up.select(F.col("node")["conv_id"].alias("conv_id"), F.col("node")["turn"].alias("turn"), F.col("up").alias("root"), "depth")
    keys = ["conv_id", "turn"]
    out = rows.join(parents, keys, "left").join(tops, keys, "left")
    return out.select(*keys, "role", "clean", "n_quotes", "quote_level", F.col("parent")["conv_id"].alias("parent_conv"), F.col("parent")["turn"].alias("parent_turn"), F.coalesce(F.col("root")["conv_id"], "conv_id").alias("root_conv"), F.coalesce(F.col("root")["turn"], "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def threads(linked: DataFrame) -> DataFrame:
    """Messages in reply order, without quotes, sorted over the whole table by range."""
    return linked.orderBy("root_conv", "root_turn", "depth", "conv_id", "turn")


def op6_quotation_links(messages: DataFrame) -> DataFrame:
    return link(messages).select("conv_id", "turn", "role", "n_quotes", "quote_level", "parent_conv", "parent_turn", "root_conv", "root_turn", "depth", F.length("clean").cast("long").alias("clean_chars"), F.sha2(F.coalesce("clean", F.lit("")), 256).alias("clean_sha256"))
