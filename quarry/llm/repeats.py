"""Operator 2, suffix-array dedup: bytes under strings of ``length`` bytes that start earlier in the corpus go.

Every window of ``length`` bytes names an anchor, the ``GRAM``-byte string of smallest hash in it, leftmost on ties, so
equal windows name equal anchors at equal offsets.  Consecutive windows with one anchor are a piece: the bytes from the
first window's start to the last one's end.  All occurrences of a window's string are in pieces of the same anchor.

 1. *Equal pieces.*  A pass deals all pieces by anchor, as hashes and places (some 20 bytes for 35 bytes of text).  Equal
    pieces are one, in a task before the exchange and in a bucket after it: all but the first are repeats as a whole.  An
    anchor that still has two different pieces or more, at the borders of repeated passages, asks for their bytes; one
    with a single piece has no repeats.  A task that sees LOCAL different pieces of an anchor sends a mark instead, and
    an anchor with a mark or more than HOT pieces is *wide*, so no bucket gets all pieces of a frequent anchor.
 2. *Fetching.*  The pieces asked for are joined to their documents, by doc_id, and cut out of the texts.
 3. *Trees.*  A bucket builds the enhanced suffix array of an anchor's different pieces (order, common prefixes, byte on
    the left), and scans it with a stack for the intervals of the common-prefix tree of ``length`` bytes and more.  An
    interval whose occurrences differ in the byte on their left, or stand at a piece's start, is a maximal repeat; every
    occurrence but the first is removed over the repeat's length.  ``repeat_groups`` gives these groups themselves.
 4. *Windows.*  Wide anchors' windows are dealt by their own strings' hashes; equal ones of a task are one first.
 5. The removed spans are joined to the documents.

A string with an earlier occurrence lies in a maximal repeat of which it isn't the first, so this removes what the rule
asks for, no more.  Pieces are equal if two 64-bit hashes are.  Nothing is broadcast, and no step depends on the size of
the corpus.

Edge cases: a null or empty text has no bytes and keeps none; texts under ``length`` bytes keep all; rows that repeat a
doc_id are the same document, and none is earlier than the other; null doc_ids are one document that comes before all; an
empty table gives an empty table; extra columns, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import text as tx
from quarry.llm.scratch import Scratch, mapped, pack64, release, runs, text_bytes, unpack64

LENGTH, GRAM = 100, 32
#: Different pieces from which an anchor is wide: in a bucket, and in a task.
HOT, LOCAL = 1024, 64
#: Pieces that a task holds before it sends them.
FLUSH = 200_000
NULL_ID = -(1 << 63)
SIGN = np.uint64(1 << 63)
FIELDS = ("anchor", "content", "doc", "start", "size")
RECORD = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("size", "<i8")])
#: Bytes of a very long document that are looked at together.
PART = 1 << 22
#: Suffixes whose bytes are compared together.
CHUNK = 1 << 14


def pieces(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Pieces of a run of documents: start and number of windows, anchor hash; and the sums that hash spans."""
    n, w = len(data), length - gram + 1
    sums = tx.prefix_hash(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), sums
    _, inv = tx._powers(n + 1)
    grams = tx.mix((sums[gram:] - sums[:-gram]) * inv[: n - gram + 1])
    low = np.uint64((1 << 24) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if w > width:
        least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
    end = np.repeat(off[1:], np.diff(off))[: n - length + 1]
    at = np.flatnonzero(np.arange(n - length + 1) + length <= end)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), sums
    anchor = (least[at] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(anchor) != 0)]))
    return at[new], np.diff(np.concatenate([new, [len(at)]])), grams[anchor[new]], sums


def _parts(off: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of documents as (first document, first byte, offsets); a very long one in parts that share length - 1 bytes."""
    for i, j in tx.slices(off):
        if j - i == 1 and off[j] - off[i] > PART:
            for a in range(int(off[i]), int(off[j]), PART):
                b = min(int(off[j]), a + PART + length - 1)
                yield i, a, np.array([0, b - a])
                if b == off[j]:
                    break
        else:
            yield i, int(off[i]), off[i : j + 1] - off[i]


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(start - (ends - size), size) + np.arange(total)]


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans by document; touching spans join."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    code = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + code * span)
    new = np.concatenate([[True], (start[1:] + code[1:] * span > reach[:-1]) | (code[1:] != code[:-1])])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(doc)]]) - 1
    return doc[at], start[at], reach[last] - code[at] * span


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of each interval of the common-prefix tree with a prefix of ``least`` or more.

    lcp[i] is the common prefix of suffixes i - 1 and i; lcp[0] is 0.
    """
    stack: list[tuple[int, int]] = []
    for i, h in enumerate([*lcp[1:], 0], 1):
        first = i - 1
        while stack and stack[-1][0] > h:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if h >= least and (not stack or stack[-1][0] < h):
            stack.append((h, first))


def _hash_of(raw: np.ndarray) -> int:
    return int(tx.span_hash(tx.prefix_hash(raw), np.zeros(1, np.int64), np.full(1, len(raw)))[0].astype(np.int64))


def repeats(content: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Maximal repeats of ``length`` and more among pieces: their length and the places in ``content`` of all occurrences.

    Pieces are runs [start, start + size) of content; those of different groups aren't compared.  What stands left of a
    piece belongs to another anchor, so at a piece's start the left side counts as different.
    """
    count = size - length + 1
    total = int(count.sum())
    piece = np.repeat(np.arange(len(start)), count)
    inner = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    pos = start[piece] + inner
    room = size[piece] - inner
    most = int(room.max())
    most += -most % 8
    padded = np.concatenate([content, np.zeros(most, np.uint8)])
    key = np.lib.stride_tricks.sliding_window_view(padded, most)[pos]
    chunks = [slice(a, a + CHUNK) for a in range(0, total, CHUNK)]  # so that masks stay small
    for c in chunks:
        key[c][np.arange(most) >= room[c, None]] = 0
    word = key.view(">u8")
    order = np.lexsort((*(word[:, c].astype(np.uint64) for c in range(word.shape[1] - 1, -1, -1)), group[piece]))
    key, pos, room, g = key[order], pos[order], room[order], group[piece][order]
    before = np.where(inner[order] > 0, padded[pos - 1].astype(np.int64), -1)
    lcp = np.full(total - 1, most)
    for c in chunks:
        differ = key[c][1:] != key[c][:-1] if c.stop >= total else key[c] != key[c.start + 1 : c.stop + 1]
        lcp[c][: len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    lcp = np.minimum(lcp, np.minimum(room[1:], room[:-1]))
    lcp[g[1:] != g[:-1]] = 0
    lcp = np.concatenate([[0], lcp])
    for depth, i, j in intervals(lcp.tolist(), length):
        b = before[i : j + 1]
        if b.min() < 0 or b.min() != b.max():
            yield depth, pos[i : j + 1]


def _reduce(rec: np.ndarray, content: np.ndarray, length: int, most: int = 60_000, groups: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed spans that a bucket's pieces show; to ``groups`` go a repeat's hash, length and all its occurrences."""
    first = np.cumsum(rec["size"]) - rec["size"]
    order = np.lexsort((rec["start"], rec["doc"], rec["content"], rec["anchor"]))
    r, at = rec[order], first[order]
    new = np.concatenate([[True], (r["content"][1:] != r["content"][:-1]) | (r["anchor"][1:] != r["anchor"][:-1])])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    gone = ~new & ((r["doc"] != r["doc"][lead]) | (r["start"] != r["start"][lead]))
    out = [(r["doc"][gone], r["start"][gone], r["start"][gone] + r["size"][gone])]
    r, at = r[new], at[new]
    edge = np.concatenate([[True], r["anchor"][1:] != r["anchor"][:-1]])
    group = np.cumsum(edge) - 1
    several = np.bincount(group)[group] > 1
    r, at, group = r[several], at[several], group[several]
    windows = np.cumsum(r["size"] - length + 1)
    i = 0
    while i < len(r):  # whole groups, about ``most`` windows at a time
        j = int(np.searchsorted(windows, (windows[i - 1] if i else 0) + most, "right"))
        j = max(j, i + 1)
        j = int(np.searchsorted(group, group[j - 1], "right"))
        part, start = r[i:j], at[i:j]
        size = part["size"]
        local, raw = np.cumsum(size) - size, _gather(content, start, size)
        for depth, where in repeats(raw, local, size, group[i:j], length):
            p = np.searchsorted(local, where, "right") - 1
            doc, begin = part["doc"][p], part["start"][p] + where - local[p]
            lead = np.lexsort((begin, doc))[0]
            later = (doc != doc[lead]) | (begin != begin[lead])
            out.append((doc[later], begin[later], begin[later] + depth))
            if groups is not None:
                groups.append((_hash_of(raw[where[0] : where[0] + depth]), depth, doc, begin))
        i = j
    return merged(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _later(group: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """An order by group, document and place; in it, who is the first of its group, and who a repeat of another place."""
    order = np.lexsort((start, doc, *group[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for g in group:
        g = g[order]
        new[1:] |= g[1:] != g[:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
    doc, start = doc[order], start[order]
    return order, new, ~new & ((doc != doc[lead]) | (start != start[lead]))


PIECES = {"bucket": pa.int32(), "anchors": pa.binary(), "contents": pa.binary(), "docs": pa.binary(), "where": pa.binary(), "marks": pa.binary(), "doc_id": pa.int64(), "start": pa.int64(), "end": pa.int64(), "anchor": pa.int64(), "content": pa.int64()}
ASKED = {"doc_id": pa.int64(), "start": pa.int64(), "end": pa.int64(), "anchor": pa.int64(), "content": pa.int64(), "wide": pa.bool_()}
FETCHED = {"bucket": pa.int32(), "records": pa.binary(), "content": pa.binary(), "doc_id": pa.int64(), "start": pa.int64(), "end": pa.int64()}
SPANS = {"doc_id": pa.int64(), "start": pa.int64(), "end": pa.int64(), "path": pa.int32(), "repeat": pa.int64()}
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}


def _ddl(schema: dict[str, pa.DataType]) -> str:
    return ", ".join(f"`{k}` {_SQL[t]}" for k, t in schema.items())


def _batch(schema: dict[str, pa.DataType], rows: int, **columns) -> pa.RecordBatch:
    """A batch of so many rows in the order of ``schema``; columns that aren't given are null."""
    made = {k: v if isinstance(v, pa.Array) else pa.array(v, schema[k]) for k, v in columns.items()}
    return pa.RecordBatch.from_pydict({k: made[k] if k in made else pa.nulls(rows, t) for k, t in schema.items()})


def _found(docs: DataFrame, length: int, groups: bool, hot: int, local: int) -> DataFrame:
    """doc_id, start, end, path (0 equal pieces, 1 trees, 2 windows of wide anchors), repeat; see ``repeated_spans``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    buckets = max(16, text_bytes(docs) >> 22)
    tasks = max(8, min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bucket_of = lambda h: ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    passing = lambda doc: -1 - np.abs(doc % 4096).astype(np.int32)

    def flush(held):
        anchor, content, doc, start, size = (np.concatenate(x) for x in zip(*held, strict=True))
        order, new, gone = _later((anchor, content), doc, start)
        anchor, content, doc, start, size = (x[order] for x in (anchor, content, doc, start, size))
        if groups:
            several = np.flatnonzero(gone)
            d, s, e = doc[several], start[several], start[several] + size[several]
            g = content[several].view(np.int64)
            yield _batch(PIECES, len(d), bucket=passing(d), doc_id=d, start=s, end=e, content=g)
        else:
            d, s, e = merged(doc[gone], start[gone], start[gone] + size[gone])
            yield _batch(PIECES, len(d), bucket=passing(d), doc_id=d, start=s, end=e)
        anchor, content, doc, start, size = (x[new] for x in (anchor, content, doc, start, size))
        edge = np.flatnonzero(np.concatenate([np.ones(min(1, len(anchor)), bool), anchor[1:] != anchor[:-1]]))
        count = np.diff(np.concatenate([edge, [len(anchor)]]))
        marks = anchor[edge[count >= local]]
        wide = np.repeat(count >= local, count)
        d, s = doc[wide], start[wide]
        yield _batch(PIECES, len(d), bucket=passing(d), doc_id=d, start=s, end=s + size[wide], anchor=anchor[wide].view(np.int64), content=content[wide].view(np.int64))
        anchor, content, doc, start, size = (x[~wide] for x in (anchor, content, doc, start, size))
        bucket, marked = bucket_of(anchor), bucket_of(marks)
        some = np.union1d(bucket, marked)
        a, b, c, d = (np.searchsorted(x, some, side) for x in (bucket, marked) for side in ("left", "right"))
        for k in range(0, len(some), 64):
            rows = range(k, min(k + 64, len(some)))
            blobs = []
            for i in rows:
                x, y = a[i], b[i]
                own, which = np.unique(doc[x:y].view(np.uint64) ^ SIGN, return_inverse=True)
                places = which.astype("<u4").tobytes() + start[x:y].astype("<u4").tobytes() + size[x:y].astype("<u2").tobytes()
                blobs.append((pack64(anchor[x:y]), content[x:y].tobytes(), pack64(own), zlib.compress(places, 1), pack64(marks[c[i] : d[i]])))
            columns = dict(zip(("anchors", "contents", "docs", "where", "marks"), zip(*blobs, strict=True), strict=True))
            yield _batch(PIECES, len(rows), bucket=some[k : k + 64], **columns)

    def send(batches):
        held, n = [], 0
        for b in batches:
            data, off = tx.utf8(b.column("text"))
            ids = b.column("doc_id").to_numpy()
            for i, a, own in _parts(off, length):
                s, c, anchor, sums = pieces(data[a : a + own[-1]], own, length)
                size = c + length - 1
                where = np.searchsorted(own, s, "right") - 1
                begin = s - own[where] + (a - off[i] if len(own) == 2 else 0)
                anchor = tx.mix(anchor)  # least hashes are small; mixed they spread evenly over the buckets
                held.append((anchor, tx.span_hash(sums, s, s + size), ids[i + where], begin, size))
                n += len(s)
                if n > FLUSH:
                    yield from flush(held)
                    held, n = [], 0
                    release()
        if held:
            yield from flush(held)

    def join_equal(batches):
        for bucket, own in runs(batches, "bucket"):
            if bucket < 0:  # spans of whole pieces, and pieces of wide anchors
                for b in own:
                    asks = b.column("anchor").is_valid()
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "end", "anchor", "content")), asks], names=list(ASKED))
                continue
            cols, marks = [], []
            for b in own:
                for x, y, z, w, m in zip(*(b.column(c) for c in ("anchors", "contents", "docs", "where", "marks")), strict=True):
                    anchor, doc = unpack64(x.as_buffer()), (unpack64(z.as_buffer()) ^ SIGN).view(np.int64)
                    n, raw = len(anchor), zlib.decompress(w.as_buffer())
                    at = lambda kind, lo, n=n, raw=raw: np.frombuffer(raw, kind, n, lo).astype(np.int64)
                    cols.append((anchor, np.frombuffer(y.as_buffer(), np.uint64), doc[at("<u4", 0)], at("<u4", 4 * n), at("<u2", 8 * n)))
                    marks.append(unpack64(m.as_buffer()))
            anchor, content, doc, start, size = (np.concatenate(x) for x in zip(*cols, strict=True))
            marks = np.unique(np.concatenate(marks))
            order, new, gone = _later((anchor, content), doc, start)
            anchor, content, doc, start, size = (x[order] for x in (anchor, content, doc, start, size))
            if groups:
                d, s, e = doc[gone], start[gone], start[gone] + size[gone]
                yield _batch(ASKED, len(d), doc_id=d, start=s, end=e, content=content[gone].view(np.int64), wide=np.zeros(len(d), bool))
            else:
                d, s, e = merged(doc[gone], start[gone], start[gone] + size[gone])
                yield _batch(ASKED, len(d), doc_id=d, start=s, end=e, wide=np.zeros(len(d), bool))
            anchor, content, doc, start, size = (x[new] for x in (anchor, content, doc, start, size))
            edge = np.flatnonzero(np.concatenate([np.ones(min(1, len(anchor)), bool), anchor[1:] != anchor[:-1]]))
            count = np.diff(np.concatenate([edge, [len(anchor)]]))
            wide = np.repeat((count > hot) | np.isin(anchor[edge], marks), count)
            ask = wide | np.repeat(count > 1, count)
            d, s = doc[ask], start[ask]
            yield _batch(ASKED, len(d), doc_id=d, start=s, end=s + size[ask], anchor=anchor[ask].view(np.int64), content=content[ask].view(np.int64), wide=wide[ask])

    def fetch(batches):
        for b in batches:
            data, off = tx.utf8(b.column("text"))
            ids, asked = b.column("doc_id").to_numpy(), b.column("asked")
            listed, flat = asked.offsets.to_numpy().astype(np.int64), asked.values
            field = {name: flat.field(k).to_numpy(zero_copy_only=False) for k, name in enumerate(("start", "end", "anchor", "content", "wide"))}
            trees, windows = [], []
            for i, j in tx.slices(off):
                x, y = listed[i], listed[j]
                owner = np.repeat(np.arange(i, j), np.diff(listed[i : j + 1]))
                start, end, anchor, content, wide = (field[k][x:y] for k in ("start", "end", "anchor", "content", "wide"))
                fits = end <= off[owner + 1] - off[owner]
                owner, start, anchor, content, wide, size = (z[fits] for z in (owner, start, anchor.view(np.uint64), content.view(np.uint64), wide.astype(bool), end - start))
                raw = _gather(data, off[owner] + start, size)
                local, sums = np.cumsum(size) - size, tx.prefix_hash(raw)
                same = tx.span_hash(sums, local, local + size) == content  # another text of this doc_id may have asked
                t = np.flatnonzero(same & ~wide)
                trees.append((anchor[t], content[t], ids[owner[t]], start[t], size[t], _gather(raw, local[t], size[t])))
                w = np.flatnonzero(same & wide)
                count = size[w] - length + 1
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                each = np.repeat(local[w], count) + step
                windows.append((tx.span_hash(sums, each, each + length), np.repeat(ids[owner[w]], count), np.repeat(start[w], count) + step))
            if windows:
                h, doc, start = (np.concatenate(x) for x in zip(*windows, strict=True))
                order, new, gone = _later((h,), doc, start)
                h, doc, start = h[order], doc[order], start[order]
                d, s, e = (doc[gone], start[gone], start[gone] + length) if groups else merged(doc[gone], start[gone], start[gone] + length)
                none = {"records": [None] * len(d)} if not groups else {"records": [x.tobytes() for x in h[gone]]}
                yield _batch(FETCHED, len(d), bucket=passing(d), doc_id=d, start=s, end=e, **none)
                h, doc, start = h[new], doc[new], start[new]
                yield from packed(h, h, doc, start, np.full(len(h), length), None, buckets)
            if trees:
                anchor, content, doc, start, size, raw = (np.concatenate(x) for x in zip(*trees, strict=True))
                yield from packed(anchor, content, doc, start, size, raw, 0)

    def packed(anchor, content, doc, start, size, raw, shift):
        """Records by bucket, with the pieces' bytes."""
        place = np.cumsum(size) - size
        rec = np.zeros(len(anchor), RECORD)
        rec["anchor"], rec["content"], rec["doc"], rec["start"], rec["size"] = anchor, content, doc, start, size
        bucket = bucket_of(rec["anchor"])
        order = np.argsort(bucket, kind="stable")
        rec, place, bucket = rec[order], place[order], bucket[order]
        ends = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(rec)] if len(rec) else [0]
        for lo in range(0, len(ends) - 1, 64):
            cuts = list(zip(ends[lo : lo + 64], ends[lo + 1 : lo + 65], strict=False))
            yield _batch(
                FETCHED, len(cuts), bucket=bucket[[x for x, _ in cuts]] + shift,
                records=[zlib.compress(b"".join(rec[f][x:y].tobytes() for f in FIELDS), 1) for x, y in cuts],
                content=[None if raw is None else zlib.compress(_gather(raw, place[x:y], rec["size"][x:y]).tobytes(), 1) for x, y in cuts],
            )

    def unpacked(blob: bytes) -> np.ndarray:
        raw = zlib.decompress(blob)
        out = np.zeros(len(raw) // RECORD.itemsize, RECORD)
        for f, col in zip(FIELDS, np.frombuffer(raw, np.uint64).reshape(len(FIELDS), -1), strict=True):
            out[f] = col.view(RECORD[f])
        return out

    def reduce(batches):
        for bucket, own in runs(batches, "bucket"):
            if bucket < 0:
                for b in own:
                    keys = [int.from_bytes(x.as_py(), "little", signed=True) if x.is_valid else None for x in b.column("records")]
                    yield _batch(SPANS, b.num_rows, doc_id=b.column("doc_id"), start=b.column("start"), end=b.column("end"), path=np.full(b.num_rows, 2), repeat=keys)
                continue
            recs, contents = [], []
            for b in own:
                recs += [unpacked(x.as_buffer()) for x in b.column("records")]
                contents += [np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8) for x in b.column("content") if x.is_valid]
            r = np.concatenate(recs)
            if bucket >= buckets:
                order, _, gone = _later((r["anchor"],), r["doc"], r["start"])
                r = r[order][gone]
                doc, start, end = (r["doc"], r["start"], r["start"] + length) if groups else merged(r["doc"], r["start"], r["start"] + length)
                keys = {"repeat": r["anchor"].view(np.int64)} if groups else {}
                yield _batch(SPANS, len(doc), doc_id=doc, start=start, end=end, path=np.full(len(doc), 2), **keys)
                continue
            seen = [] if groups else None
            doc, start, end = _reduce(r, np.concatenate(contents), length, groups=seen)
            if not groups:
                yield _batch(SPANS, len(doc), doc_id=doc, start=start, end=end, path=np.full(len(doc), 1))
            for key, depth, doc, start in seen or ():
                yield _batch(SPANS, len(doc), doc_id=doc, start=start, end=start + depth, path=np.full(len(doc), 1), repeat=np.full(len(doc), key))

    dealt = mapped(docs, send, _ddl(PIECES)).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    equal = scratch.keep(mapped(dealt, join_equal, _ddl(ASKED)), "equal")
    asked = equal.where("anchor is not null").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "end", "anchor", "content", "wide")).alias("asked"))
    texts = docs.join(asked, F.col("doc_id") == F.col("id")).select("doc_id", "text", "asked")
    fetched = mapped(texts, fetch, _ddl(FETCHED)).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    rest = scratch.keep(mapped(fetched, reduce, _ddl(SPANS)), "rest")
    whole = equal.where("anchor is null").select("doc_id", "start", "end", F.lit(0).alias("path"), F.col("content").alias("repeat"))
    return whole.unionByName(rest)


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, local: int = LOCAL) -> DataFrame:
    """doc_id, start, end (bytes), path: spans under strings that start earlier; they may overlap or touch."""
    return _found(docs, length, False, hot, local).drop("repeat")


def repeat_groups(docs: DataFrame, length: int = LENGTH, hot: int = HOT, local: int = LOCAL) -> DataFrame:
    """repeat (the string's hash), doc_id, start, end, path: occurrences of strings of ``length`` bytes and more.

    path 1: the maximal repeats of the trees with all occurrences, the first too; paths 0 and 2: pieces and windows that
    equal an earlier one, under its string's hash.
    """
    return _found(docs, length, True, hot, local)


def remove(docs: DataFrame, spans: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cuts spans from texts.  Without columns: doc_id and the digest of what is left; else these columns, text cut.

    A cut inside a character drops the rest of that character from the text column, not from the digest.
    """
    listed = spans.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    digest = columns is None
    wanted = ["doc_id", "text"] if digest else columns
    keyed = docs.select(F.struct(*wanted).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"))
    both = keyed.join(listed, F.col("key") == F.col("id"), "left").select("doc", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else docs.select(*wanted).schema

    def run(batches):
        for b in batches:
            doc = dict(zip(wanted, b.column("doc").flatten(), strict=True))
            out, texts = [], []
            for text, found in zip(doc["text"], b.column("spans"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                s = e = np.zeros(0, np.int64)
                if found.is_valid and len(found):
                    flat = found.values
                    _, s, e = merged(np.zeros(len(flat), np.int64), flat.field(0).to_numpy(), flat.field(1).to_numpy())
                kept, at = [], 0
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    kept.append(raw[at:x])
                    at = y
                left = b"".join([*kept, raw[at:]])
                if digest:
                    out.append((len(raw), int((e - s).sum()), len(s), hashlib.sha256(left).hexdigest()))
                else:
                    texts.append(left.decode("utf-8", "ignore") if text.is_valid else None)
            if digest:
                n, r, k, h = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_pydict({"doc_id": doc["doc_id"].cast(pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(r, pa.int64()), "n_spans": pa.array(k, pa.int64()), "kept_sha256": pa.array(h, pa.string())})
            else:
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else doc[c] for c in wanted], names=wanted)

    return mapped(both, run, schema)


def op2_suffix_dedup(docs: DataFrame) -> DataFrame:
    return remove(docs, repeated_spans(docs))
