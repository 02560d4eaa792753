"""Operator 1, n-gram Jaccard join: a blocked sparse product of documents by shingles, with size-derived bounds.

Rows of the matrix are distinct shingle sets (equal sets are one row, known by a 64-bit hash and the set's size), so
copies never meet as pairs.  A set of n shingles needs an overlap of need = ceil(t n) with any partner.

 1. *Sketch.*  Of each set the n - need + 1 + need // 5 shingles of smallest hash are exchanged by shingle; two rows that
    reach the threshold share 1 + need // 5 of these or more.  Rows of which fewer are shared with any other row leave;
    what stays are *candidates*.  A task sends a shingle that two of its rows hold once, without rows.
 2. *Incidence.*  The candidates' whole sets are exchanged by shingle, into column blocks, and come back to their rows
    with what the columns hold: a shingle of one row is dropped, one of HOT rows and more is *frequent*.  A task that
    sees HOT rows of a shingle sends a mark instead of the rows, so no column gets all rows of a frequent shingle.  A
    row with fewer than need shared shingles leaves; others keep them as the set that pairs are verified on.
 3. *Product.*  Rows enter it with their prefix: of their shared shingles in a common order, frequent ones last, all but
    the last need - 1; two rows that reach the threshold meet in their prefixes.  A block multiplies its columns with
    its rows; no column in a block holds HOT rows, so the work is bounded by HOT times the entries.  Overlaps are summed
    over blocks, and pairs discarded whose sizes or summed overlaps rule out the threshold.
 4. *Lists.*  Entries under frequent shingles (texts that are mostly passages of many documents, large groups of near
    copies) are lists of any length.  Each list is first compared with a hub only, the row with the largest share of
    shared shingles (the text that others were made from has nothing of its own); then, under the components so found,
    with the hub of the rows outside the list's main component.  A list that holds more than a 2,048th of all entries is
    joined by broadcast (there are fewer than 2,048 of them), so no task gets one whole.
 5. Each row's best partner and the stars are verified on the exact sets and linked; then what is left are pairs across
    different components.  Frequent lists that are one component by now, which large groups of near copies are, need
    nothing more; in others only rows outside the list's main component meet the rest, if their frequent shingles alone,
    from a common one on, leave room for the threshold (what they share of others is summed before).
 6. Links give components by star contraction; no step collects links or labels, and nothing that is broadcast grows
    with the data.

Every pair that the threshold links is either verified or already inside one component, so components are exact, but for
collisions of 64-bit hashes.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of fewer
words than ``width`` is one shingle; repeated rows have equal sets and share a component; different texts under one
doc_id are rows of their own; a row without doc_id is linked like others, and its component is named by the smallest
doc_id that isn't null (null, if there is none); an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import text as tx
from quarry.llm.components import components
from quarry.llm.scratch import Scratch, join_spread, mapped, pack64, runs, text_bytes, unpack64

#: Rows that make a shingle frequent; also the longest column that is multiplied out.
HOT = 40
#: Entries of a column block, about; entries that a task holds before it sends them; pairs that a block sums at once.
BLOCK, FLUSH, PAIRS = 250_000, 1_000_000, 1_000_000


def _sign(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _row_keys(hashes: np.ndarray, so: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = tx.grouped_sum(tx.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), so)
    return tx.mix(total + np.diff(so).astype(np.uint64) * tx.MULT[61])


def _need(n, num: int, den: int):
    """The smallest overlap with which a set of size n can reach the threshold num / den: ceil(t n)."""
    return -(-n * num // den)


def _batch(schema: dict[str, pa.DataType], rows: int, /, **columns) -> pa.RecordBatch:
    """A batch of so many rows in the order of ``schema``; columns that aren't given are null."""
    made = {k: v if isinstance(v, pa.Array) else pa.array(v, schema[k]) for k, v in columns.items()}
    return pa.RecordBatch.from_pydict({k: made[k] if k in made else pa.nulls(rows, t) for k, t in schema.items()})


def _cuts(key: np.ndarray) -> list[int]:
    """Where runs of equal keys start, and the end."""
    return [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else [0]


def _block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Ranges of hashes, so that hashes in order are blocks in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


L, B, I = pa.int64(), pa.binary(), pa.int32()
SKETCH = {"block": I, "flush": L, "ones": B, "rows": B, "many": B, "doc_id": L, "text_key": L, "row": L, "n": L, "c": L, "bucket": I, "counts": B}
COUNT = np.dtype([("row", "<u8"), ("flush", "<i8"), ("c", "<u4")])
COLUMN = {"block": I, "ones": B, "rows": B, "many": B, "bucket": I, "own": B}


def _ddl(schema: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {'long' if t == L else 'int' if t == I else 'binary'}" for k, t in schema.items())


def _sketch(docs: DataFrame, width: int, num: int, den: int, blocks: int, tasks: int) -> DataFrame:
    """Documents (doc_id, text_key, row, n, flush, c) and packed numbers (row, flush, c) of a row's sketch that others share.

    c adds up, over all of one (row, flush), to the number of the set's sketch shingles that other sets hold.
    """

    def flush(held, docs, number):
        """The documents of a flush, and its entries by block: shingles of one row with it, of several without."""
        h, r = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((r, h))
        h, r = h[order], r[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[new], r[new]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([start, [len(h)]]))
        shared = np.repeat(size > 1, size)
        here, times = np.unique(r[shared], return_counts=True)
        for ids, keys, row, n in docs:
            u, first = np.unique(row, return_index=True)
            at = np.minimum(np.searchsorted(here, u), max(len(here) - 1, 0))
            c = np.zeros(len(row), np.int64)
            if len(here):
                c[first] = np.where(here[at] == u, times[at], 0)
                here, times = here[~np.isin(here, u)], times[~np.isin(here, u)]  # once for each row
            yield _batch(SKETCH, len(row), block=-1 - np.arange(len(row)) % 4096, flush=np.full(len(row), number), doc_id=ids, text_key=keys, row=_sign(row), n=n, c=c)
        one, many = ~shared, h[start[size > 1]]
        oh, orow = h[one], r[one]
        blocks_of = np.union1d(_block_of(oh, blocks), _block_of(many, blocks))
        a, b = np.searchsorted(_block_of(oh, blocks), blocks_of), np.searchsorted(_block_of(oh, blocks), blocks_of, "right")
        c, d = np.searchsorted(_block_of(many, blocks), blocks_of), np.searchsorted(_block_of(many, blocks), blocks_of, "right")
        for k in range(0, len(blocks_of), 64):
            s = range(k, min(k + 64, len(blocks_of)))
            yield _batch(SKETCH, len(s), block=blocks_of[k : k + 64], flush=np.full(len(s), number), ones=[pack64(oh[a[i] : b[i]]) for i in s], rows=[orow[a[i] : b[i]].tobytes() for i in s], many=[pack64(many[c[i] : d[i]]) for i in s])

    def send(batches):
        number = TaskContext.get().partitionId() << 32
        held, rows, size = [], [], 0
        for b in batches:
            data, off = tx.utf8(b.column("text"))
            for i, j in tx.slices(off):
                h, so = tx.shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], width)
                n, row = np.diff(so), _row_keys(h, so)
                need = _need(n, num, den)
                keep = n - need + np.minimum(n, 1) + need // 5
                take = np.arange(len(h)) - np.repeat(so[:-1], n) < np.repeat(keep, n)  # ascending within each set
                held.append((tx.mix(h[take]), np.repeat(row, n)[take]))  # least hashes are small; mixed they spread evenly
                rows.append((b.column("doc_id").slice(i, j - i), b.column("text_key").slice(i, j - i), row, n))
                size += int(take.sum()) + j - i
                if size > FLUSH:
                    yield from flush(held, rows, number)
                    held, rows, size, number = [], [], 0, number + 1
        if rows:
            yield from flush(held, rows, number)

    def added(held: list[np.ndarray]) -> np.ndarray:
        x = np.concatenate(held)
        x = x[np.lexsort((x["flush"], x["row"]))]
        at = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), (x["row"][1:] != x["row"][:-1]) | (x["flush"][1:] != x["flush"][:-1])]))
        out = x[at]
        out["c"] = np.add.reduceat(x["c"], at) if len(x) else 0
        return out

    def dealt(held):
        x = added(held)
        bucket = (x["row"] % np.uint64(tasks)).astype(np.int64)
        x = x[np.argsort(bucket, kind="stable")]
        bucket = np.sort(bucket)
        ends = _cuts(bucket)
        for k in range(0, len(ends) - 1, 64):
            cut = list(zip(ends[k : k + 64], ends[k + 1 : k + 65], strict=False))
            yield _batch(SKETCH, len(cut), bucket=bucket[[i for i, _ in cut]], counts=[x[i:j].tobytes() for i, j in cut])

    def count(batches):
        held, size = [], 0
        for block, own in runs(batches, "block"):
            if block < 0:
                yield from own
                continue
            h, r, f, many = [], [], [], []
            for b in own:
                for ones, rows, number, more in zip(b.column("ones"), b.column("rows"), b.column("flush").to_pylist(), b.column("many"), strict=True):
                    h.append(unpack64(ones.as_buffer()))
                    r.append(np.frombuffer(rows.as_buffer(), np.uint64))
                    f.append(np.full(len(h[-1]), number))
                    many.append(unpack64(more.as_buffer()))
            h, r, f, many = np.concatenate(h), np.concatenate(r), np.concatenate(f), np.unique(np.concatenate(many))
            if not len(h):
                continue
            order = np.lexsort((r, h))
            h, r, f = h[order], r[order], f[order]
            edge = np.concatenate([[True], h[1:] != h[:-1]])
            column = np.cumsum(edge) - 1
            other = np.zeros(int(column[-1]) + 1, bool)  # columns of two rows and more
            other[column[1:][~edge[1:] & (r[1:] != r[:-1])]] = True
            if len(many):
                at = np.minimum(np.searchsorted(many, h), len(many) - 1)
                other[column[many[at] == h]] = True
            shared = other[column]
            x = np.empty(int(shared.sum()), COUNT)
            x["row"], x["flush"], x["c"] = r[shared], f[shared], 1
            held.append(added([x]))
            size += len(held[-1])
            if size > FLUSH:
                yield from dealt(held)
                held, size = [], 0
        if size:
            yield from dealt(held)

    sent = mapped(docs, send, _ddl(SKETCH)).repartition(tasks, "block").sortWithinPartitions("block")
    return mapped(sent, count, _ddl(SKETCH)).drop("block", "ones", "rows", "many")


def _shared(first: DataFrame, tasks: int) -> DataFrame:
    """row, c: how many sketch shingles of each row others share."""

    def add(batches):
        for _, own in runs(batches, "bucket"):
            x = np.concatenate([np.frombuffer(v.as_buffer(), COUNT) for b in own for v in b.column("counts")])
            x = x[np.lexsort((x["flush"], x["row"]))]
            at = np.flatnonzero(np.concatenate([[True], (x["row"][1:] != x["row"][:-1]) | (x["flush"][1:] != x["flush"][:-1])]))
            yield pa.RecordBatch.from_pydict({"row": pa.array(_sign(x["row"][at])), "flush": pa.array(x["flush"][at]), "c": pa.array(np.add.reduceat(x["c"], at).astype(np.int64))})

    packed = first.where("counts is not null").select("bucket", "counts").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    one = mapped(packed, add, "row long, flush long, c long").unionByName(first.where("c > 0").select("row", "flush", "c"))
    return one.groupBy("row", "flush").agg(F.sum("c").alias("c")).groupBy("row").agg(F.max("c").alias("c"))


def _incidence(docs: DataFrame, width: int, hot: int, blocks: int, buckets: int, tasks: int) -> DataFrame:
    """Packed by bucket of rows, what the columns say of candidates: (row, shingle, frequent) of shared shingles, and n.

    docs: row, text; a text whose set is another row's isn't taken.  A record is three 64-bit numbers: row, shingle and 0
    or 1, or row, n and 2.
    """

    def dealt(row, what, kind):
        """Records by bucket."""
        bucket = (row % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rec = np.stack([row, what, kind.astype(np.uint64)], axis=1)[order]
        ends = _cuts(bucket[order])
        at = bucket[order]
        for k in range(0, len(ends) - 1, 64):
            cut = list(zip(ends[k : k + 64], ends[k + 1 : k + 65], strict=False))
            yield [int(at[x]) for x, _ in cut], [rec[x:y].tobytes() for x, y in cut]

    def send(batches):
        held, size, sizes = [], 0, []

        def flush():
            h, r = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((r, h))
            h, r = h[order], r[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            h, r = h[new], r[new]
            start = np.asarray(_cuts(h))
            long = np.diff(start) >= hot
            mark = h[start[:-1][long]]
            wide = np.repeat(long, np.diff(start))
            row, n = (np.concatenate(x) for x in zip(*sizes, strict=True))
            records = (np.concatenate([r[wide], row]), np.concatenate([h[wide], n.astype(np.uint64)]), np.concatenate([np.ones(int(wide.sum()), np.uint64), np.full(len(row), 2, np.uint64)]))
            for at, blob in dealt(*records):
                yield _batch(COLUMN, len(at), block=[-1 - x for x in at], bucket=at, own=blob)
            h, r = h[~wide], r[~wide]
            block, marked = _block_of(h, blocks), _block_of(mark, blocks)
            for k in np.array_split(np.union1d(block, marked), max(1, blocks // 64)):
                if len(k):
                    a, b, c, d = np.searchsorted(block, k), np.searchsorted(block, k, "right"), np.searchsorted(marked, k), np.searchsorted(marked, k, "right")
                    s = range(len(k))
                    yield _batch(COLUMN, len(k), block=k, ones=[pack64(h[a[i] : b[i]]) for i in s], rows=[r[a[i] : b[i]].tobytes() for i in s], many=[pack64(mark[c[i] : d[i]]) for i in s])

        for b in batches:
            data, off = tx.utf8(b.column("text"))
            want = b.column("row").to_numpy().view(np.uint64)
            for i, j in tx.slices(off):
                h, so = tx.shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], width)
                n, row = np.diff(so), _row_keys(h, so)
                mine = row == want[i:j]
                take = np.repeat(mine, n)
                held.append((h[take], np.repeat(row, n)[take]))
                sizes.append((row[mine], n[mine]))
                size += int(take.sum())
                if size > FLUSH:
                    yield from flush()
                    held, size, sizes = [], 0, []
        if held:
            yield from flush()

    def back(batches):
        for block, own in runs(batches, "block"):
            if block < 0:
                yield from own
                continue
            h, r, many = [], [], []
            for b in own:
                for ones, rows, more in zip(b.column("ones"), b.column("rows"), b.column("many"), strict=True):
                    h.append(unpack64(ones.as_buffer()))
                    r.append(np.frombuffer(rows.as_buffer(), np.uint64))
                    many.append(unpack64(more.as_buffer()))
            h, r, many = np.concatenate(h), np.concatenate(r), np.unique(np.concatenate(many))
            order = np.lexsort((r, h))
            h, r = h[order], r[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            h, r = h[new], r[new]
            size = np.diff(np.asarray(_cuts(h)))
            times = np.repeat(size, size)
            marked = many[np.minimum(np.searchsorted(many, h), len(many) - 1)] == h if len(many) and len(h) else np.zeros(len(h), bool)
            frequent = marked | (times >= hot)
            shared = frequent | (times > 1)
            for at, blob in dealt(r[shared], h[shared], frequent[shared]):
                yield _batch(COLUMN, len(at), bucket=at, own=blob)

    sent = mapped(docs, send, _ddl(COLUMN)).repartition(tasks, "block").sortWithinPartitions("block")
    return mapped(sent, back, _ddl(COLUMN)).select("bucket", "own")


ENTRY = {"block": I, "blob": B, "shingle": L, "row": L, "n": L, "own": L, "hot": L, "rank": L}
KIND = np.dtype([("h", "<u8"), ("r", "<u8"), ("n", "<u4")])


def _entries(shared: DataFrame, num: int, den: int, blocks: int, tasks: int) -> DataFrame:
    """Rows with need shared shingles: their shared set (block -2), and their prefix, packed (block >= 0) or, under
    frequent shingles, as single entries (block -1).

    own counts a row's shingles that nobody shares, hot its frequent ones; rank is an entry's place among these.
    """

    def run(batches):
        for _, group in runs(batches, "bucket"):
            rec = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 3) for b in group for x in b.column("own")])
            sizes = rec[rec[:, 2] == 2]
            rec = rec[rec[:, 2] < 2]
            row, first = np.unique(sizes[:, 0], return_index=True)
            n = sizes[first, 1].astype(np.int64)
            order = np.lexsort((1 - rec[:, 2], rec[:, 1], rec[:, 0]))  # of a shingle that comes twice, the frequent one
            rec = rec[order]
            new = np.ones(len(rec), bool)
            new[1:] = (rec[1:, 0] != rec[:-1, 0]) | (rec[1:, 1] != rec[:-1, 1])
            rec = rec[new]
            owner = np.searchsorted(row, rec[:, 0])
            some = np.bincount(owner, minlength=len(row))
            prefix = some - _need(n, num, den) + 1
            live = (prefix > 0)[owner]
            h, hot, owner = rec[live, 1], rec[live, 2].astype(bool), owner[live]
            for part in np.array_split(np.flatnonzero(prefix > 0), max(1, len(h) // 200_000)):
                if len(part):
                    a, b = np.searchsorted(owner, part), np.searchsorted(owner, part, "right")
                    yield _batch(ENTRY, len(part), block=np.full(len(part), -2), blob=[h[x:y].tobytes() for x, y in zip(a, b, strict=True)], row=_sign(row[part]), n=n[part])
            hots, colds = np.bincount(owner[hot], minlength=len(row)), np.bincount(owner[~hot], minlength=len(row))
            order = np.lexsort((h, hot, owner))  # frequent ones last, then by hash
            h, hot = h[order], hot[order]
            at = np.arange(len(h)) - np.searchsorted(owner, owner)
            take = at < prefix[owner]
            h, hot, owner, at = h[take], hot[take], owner[take], at[take]
            flag = np.zeros(len(row), np.uint32)
            flag[owner[hot]] = np.uint32(1 << 31)  # rows that also have entries outside the blocks
            e = np.empty(int((~hot).sum()), KIND)
            e["h"], e["r"], e["n"] = h[~hot], row[owner[~hot]], n[owner[~hot]].astype(np.uint32) | flag[owner[~hot]]
            block = _block_of(tx.mix(e["h"]), blocks)  # prefixes hold small hashes
            order = np.argsort(block, kind="stable")
            e, block = e[order], block[order]
            ends = _cuts(block)
            for k in range(0, len(ends) - 1, 256):
                cut = list(zip(ends[k : k + 256], ends[k + 1 : k + 257], strict=False))
                yield _batch(ENTRY, len(cut), block=[int(block[x]) for x, _ in cut], blob=[e[x:y].tobytes() for x, y in cut])
            w = owner[hot]
            for k in range(0, len(w), 100_000):
                o = w[k : k + 100_000]
                yield _batch(ENTRY, len(o), block=np.full(len(o), -1), shingle=_sign(h[hot][k : k + 100_000]), row=_sign(row[o]), n=n[o], own=(n - some)[o], hot=hots[o], rank=(at - colds[owner])[hot][k : k + 100_000])

    dealt = shared.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return mapped(dealt, run, _ddl(ENTRY))


def _product(packed: DataFrame, num: int, den: int, tasks: int) -> DataFrame:
    """Overlaps of pairs of rows within each block: a < b, sizes, overlap, and whether both have entries elsewhere."""

    def multiplied(e):
        edge = np.asarray(_cuts(e["h"]))
        run_end = np.repeat(edge[1:], np.diff(edge))
        n = (e["n"] & np.uint32(0x7FFFFFFF)).astype(np.int64)
        flag = e["n"] >> np.uint32(31)
        got, d = [], 1
        live = np.flatnonzero(np.arange(len(e)) + 1 < run_end)
        while len(live):
            i, j = live, live + d
            fits = np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num
            got.append((i[fits], j[fits]))
            d += 1
            live = live[live + d < run_end[live]]
        i, j = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 2
        if not len(i):
            return
        ra, rb = _sign(e["r"][i]), _sign(e["r"][j])
        swap = ra > rb
        a, b = np.where(swap, rb, ra), np.where(swap, ra, rb)
        na, nb = np.where(swap, n[j], n[i]), np.where(swap, n[i], n[j])
        both = (flag[i] & flag[j]).astype(np.int64)
        order = np.lexsort((b, a))
        a, b, na, nb, both = a[order], b[order], na[order], nb[order], both[order]
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        count = np.diff(np.concatenate([at, [len(a)]]))
        for k in range(0, len(at), 100_000):
            s = at[k : k + 100_000]
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[s]), "b": pa.array(b[s]), "na": pa.array(na[s]), "nb": pa.array(nb[s]), "both": pa.array(both[s]), "overlap": pa.array(count[k : k + 100_000].astype(np.int64))})

    def run(batches):
        for _, own in runs(batches, "block"):
            e = np.concatenate([np.frombuffer(x.as_buffer(), KIND) for b in own for x in b.column("blob")])
            e = e[np.lexsort((e["r"], e["h"]))]
            edge = np.asarray(_cuts(e["h"]))
            size = np.diff(edge)
            pairs = np.cumsum(size * (size - 1) // 2)
            part = np.concatenate([pairs[:1] * 0, pairs[:-1]]) // PAIRS  # whole columns, about PAIRS pairs at a time
            ends = _cuts(part)
            for x, y in zip(ends[:-1], ends[1:], strict=True):
                yield from multiplied(e[edge[x] : edge[y]])

    dealt = packed.repartition(tasks, "block").sortWithinPartitions("block")
    return mapped(dealt, run, "a long, b long, na long, nb long, both long, overlap long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of rows whose sets reach the threshold.  sets: row, n and the shared shingles in order."""

    def test(batches):
        for b in batches:
            keep = []
            for x, y, p, q in zip(b.column("x"), b.column("y"), b.column("p").to_pylist(), b.column("q").to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (p + q - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("row").alias("a"), F.col("blob").alias("x"), F.col("n").alias("p"))
    right = sets.select(F.col("row").alias("b"), F.col("blob").alias("y"), F.col("n").alias("q"))
    return mapped(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y", "p", "q"), test, "a long, b long")


def linked(docs: DataFrame, width: int = 5, num: int = 3, den: int = 4, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, n, root, least for every row: rows of equal root are one component, whose smallest doc_id is least;
    both are null without words."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    size = text_bytes(docs)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(8, int(size / 7 * (1.2 - num / den) / block) + 1)
    tasks = max(8, min(blocks, partitions))
    first = scratch.keep(_sketch(docs, width, num, den, blocks, tasks), "first")
    rows = first.where("n is not null").select("doc_id", "text_key", "row", "n")
    members = first.where("n > 0").groupBy("row", "n").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "text_key")).alias("key"))
    members = scratch.keep(members, "members")
    shared = _shared(first, tasks)
    need = lambda n: F.ceil(F.col(n) * num / den)
    candidates = members.join(shared, "row").where(F.col("c") > F.floor(need("n") / 5)).select("row", "n", F.col("key.doc_id").alias("_id"), F.col("key.text_key").alias("_key"))
    candidates = scratch.keep(candidates, "candidates")

    cells = int(candidates.agg(F.sum("n")).first()[0] or 0)
    blocks, buckets = max(8, cells // block + 1), max(8, cells // block + 1)
    tasks = max(8, min(blocks, partitions))
    texts = docs.join(candidates.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("row", "text")
    columns = scratch.keep(_incidence(texts, width, hot, blocks, buckets, tasks), "columns")
    entries = scratch.keep(_entries(columns, num, den, blocks, tasks), "entries")
    scratch.drop("columns")
    sets = entries.where("block = -2").select("row", "n", "blob")
    product = _product(entries.where("block >= 0").select("block", "blob"), num, den, tasks)
    summed = product.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("both").alias("both"))
    # of a common overlap, what isn't in both prefixes lies behind the prefix that ends first
    behind = F.greatest(need("na"), need("nb")) - 1
    required = F.ceil((F.col("na") + F.col("nb")) * num / (num + den))
    pairs = scratch.keep(summed.where((F.col("both") == 1) | (F.col("overlap") + behind >= required)), "pairs")

    # lists under frequent shingles, cut by size so that sizes that rule each other out seldom meet
    ratio = den / num * 1.005
    level: Column = F.floor(F.log(F.col("n").cast("double")) / float(np.log(ratio))).cast("int")
    # own: shingles of no other row; both rows of a pair must reach the overlap without them
    single = entries.where("block = -1").select("shingle", "row", "n", "own", "hot", "rank")
    lists = single.withColumn("level", F.explode(F.array(level, level + 1)))
    keys = ["shingle", "level"]
    fits = (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (F.least(F.col("na") - F.col("oa"), F.col("nb") - F.col("ob")) * (num + den) >= (F.col("na") + F.col("nb")) * num)
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    central = F.struct((-F.col("own") / F.col("n")).alias("c"), "row", "n", "own")

    def to_hubs(rows: DataFrame, left: DataFrame, name: str) -> DataFrame:
        """Pairs of the lists' rows with the hub of the rows ``left``."""
        hubs = scratch.keep(left.groupBy(*keys).agg(F.max(central).alias("hub")), f"{name}hub")
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("size"))
        met = join_spread(rows, hubs, keys, sizes, scratch, f"{name}size").select(F.col("hub")["row"].alias("a"), F.col("hub")["n"].alias("na"), F.col("hub")["own"].alias("oa"), F.col("row").alias("b"), F.col("n").alias("nb"), F.col("own").alias("ob"))
        return met.where((F.col("a") != F.col("b")) & fits).select("a", "b").distinct()

    def labelled(df: DataFrame, label: DataFrame, key: str, out: str) -> DataFrame:
        named = label.select(F.col("node").alias("_node"), F.col("root").alias(out))
        return df.join(named, F.col(key) == F.col("_node"), "left").drop("_node").withColumn(out, F.coalesce(F.col(out), F.col(key)))

    both_ways = pairs.select("a", "b", "overlap").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap"))
    best = both_ways.groupBy("b").agg(F.max(F.struct("overlap", F.col("a"))).alias("top")).select(F.col("top")["a"].alias("a"), "b")
    tried = scratch.keep(ordered(best.unionByName(to_hubs(lists, lists, "first"))), "tried")
    links = scratch.keep(_verified(tried, sets, num, den), "links1")

    def still_open(lists: DataFrame, label: DataFrame, name: str) -> DataFrame:
        """Rows of lists that have several components, with their label and the list's main one."""
        tagged = scratch.keep(labelled(lists.drop("label", "main"), label, "row", "label"), f"{name}tagged")
        main = tagged.groupBy(*keys, "label").count().groupBy(*keys).agg(F.max(F.struct("count", "label"))["label"].alias("main"), F.count("*").alias("labels"), F.sum("count").alias("size"))
        main = scratch.keep(main, f"{name}main")
        return join_spread(tagged, main.where("labels > 1").select(*keys, "main"), keys, main.select(*keys, "size"), scratch, f"{name}size")

    label = components(links, scratch, "cc_hub")
    lists = scratch.keep(still_open(lists, label, "a"), "open1")
    again = scratch.keep(ordered(to_hubs(lists, lists.where("label <> main"), "second")).join(tried, ["a", "b"], "left_anti"), "again")
    links = scratch.keep(links.unionByName(_verified(again, sets, num, den)), "links2")
    label = components(links, scratch, "cc_again")
    lists = scratch.keep(still_open(lists, label, "b"), "open2")

    # rows of lists have all their other shared shingles in their prefixes: what a pair of them shares of these is summed
    # in pairs, or nothing, and the rest of their overlap lies in frequent shingles
    heat = single.select("row", "hot").distinct()
    heat_of = lambda x: heat.select(F.col("row").alias(x), F.col("hot").alias(f"h{x}"))
    across = labelled(labelled(pairs.withColumn("required", required), label, "a", "la"), label, "b", "lb").where("la <> lb")
    across = across.join(heat_of("a"), "a", "left").join(heat_of("b"), "b", "left")
    across = across.where((F.col("both") == 0) | (F.col("overlap") + F.least("ha", "hb") >= F.col("required"))).select("a", "b")
    # all that the others share comes at or after the first shingle that they share, so too little may be left behind it;
    # the smaller of a pair needs 2 t / (1 + t) of itself there, so texts with more of their own make no pairs
    rest = F.col("hot") - F.col("rank")
    side = lambda df, x: df.select(*keys, "main", F.col("row").alias(x), F.col("label").alias(f"label_{x}"), rest.alias(f"rest_{x}"), F.col("n").alias(f"n{x}"))
    small = side(lists.where(rest >= F.ceil(F.col("n") * 2 * num / (num + den))), "a")
    large = side(lists.where(rest >= need("n")), "b").drop("main")
    met = small.where("label_a <> main").join(large, keys).unionByName(small.where("label_a = main").join(large, keys).where("label_b <> main"))
    once = F.col("level") == F.floor(F.log(F.col("nb").cast("double")) / float(np.log(ratio)))
    fits = (F.col("na") <= F.col("nb")) & (F.col("na") * den >= F.col("nb") * num) & (F.least("rest_a", "rest_b") >= required)
    met = met.where((F.col("label_a") != F.col("label_b")) & fits & once).select("a", "b")
    last = ordered(across.unionByName(met)).join(tried, ["a", "b"], "left_anti").join(again, ["a", "b"], "left_anti")
    last = scratch.keep(last, "last")
    links = links.unionByName(scratch.keep(_verified(last, sets, num, den), "links3"))
    final = components(links, scratch, "cc_last")

    # of each row its root, and of each root its smallest doc_id; only then to the documents, of which copies share a row
    named = final.select(F.col("node").alias("row"), "root")
    rooted = scratch.keep(members.select("row", "doc_id").join(named, "row", "left").withColumn("root", F.coalesce("root", "row")), "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    whole = join_spread(rooted.drop("doc_id"), least, ["root"], rooted.groupBy("root").agg(F.count("*").alias("size")), scratch, "rootsize")
    full = rows.where("n > 0")
    found = join_spread(full, whole, ["row"], full.groupBy("row").agg(F.count("*").alias("size")), scratch, "rowsize")
    cols = ["doc_id", "text_key", "n", "root", "least"]
    none = F.lit(None).cast("long")
    return found.select(*cols).unionByName(rows.where("n = 0").withColumns({"root": none, "least": none}).select(*cols))


def jaccard_components(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: components of Jaccard similarity num / den and more."""
    return linked(docs, **how).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One document of each component, that of smallest doc_id (a null one only if there is no other); all without words.

    Of rows that repeat doc_id and text any one stays.
    """
    found = Scratch(docs.sparkSession).keep(linked(docs, **how), "linked")
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("f"))
    first = first.select(F.col("f.doc_id").alias("_id"), F.col("f.text_key").alias("_key"), F.lit(True).alias("_one"))
    bare = found.where("root is null").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.lit(False).alias("_one")).distinct()
    keyed = docs.withColumns({"_doc": F.col("doc_id").cast("long"), "_text": F.xxhash64("text")})
    kept = keyed.join(first.unionByName(bare), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")))
    one = kept.where("_one").dropDuplicates(["_doc", "_text"])
    return one.unionByName(kept.where("not _one")).select(*docs.columns)


def op1_ngram_jaccard(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)
