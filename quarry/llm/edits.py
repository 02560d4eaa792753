"""Operator 5, token counts that follow edits: a segment tree of pre-token pieces per document.

A text is cut into pieces by the vocabulary's pattern; slots hold them, at first one each, and the inner nodes of a binary
tree over the slots hold sums of characters and tokens.  An edit descends to the piece at its place, goes back while a
piece could still see the edited characters (the pattern looks at most two characters ahead), and cuts the new text from
there until a cut falls on an old border behind the edit: from there on the old pieces hold.  Only pieces between are
encoded anew; they take the place of the old ones in their slots, and the sums on the way to the root are updated.  A slot
that has come to hold many pieces makes the tree deal its pieces to slots again, without encoding any.

``trees`` gives a table of texts and their trees, which can be stored; ``edited`` applies a table of edits to such a table
and gives the next one, so a document's pieces are encoded once and later only where it is edited.  ``counted`` does both
in one pass.

Edge cases: a null or empty text has no pieces and 0 tokens, and an insertion makes its first; edits beyond the end act
at the end; edits of one document apply in order of ``seq``, each to the text that the one before left; documents without
edits keep their counts; repeated rows are counted and edited each; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import default_vocabulary, pieces_of, read
from quarry.llm.scratch import mapped

#: Characters behind its end that decide a piece; pieces of a slot that make the tree deal anew.
AHEAD, MANY = 2, 256


class Tree:
    """``own`` holds each slot's pieces (characters, tokens); ``chars`` and ``tokens`` the sums of a binary tree, the root at 1."""

    def __init__(self, text: str, pattern: regex.Pattern, count, leaves: list[tuple[int, int]] | None = None):
        self.text, self.cut, self.count, self.encoded = text, pattern.match, count, 0
        self._deal([(len(p), count(p)) for p in pattern.findall(text)] if leaves is None else leaves)

    def _deal(self, leaves: list[tuple[int, int]]) -> None:
        self.slots = max(len(leaves), 1)
        self.width = 1 << (self.slots - 1).bit_length()
        self.own = [[x] for x in leaves] or [[]]
        self.chars = self._sums([a for a, _ in leaves])
        self.tokens = self._sums([b for _, b in leaves])

    def _sums(self, leaves: list[int]) -> list[int]:
        level = np.zeros(self.width, np.int64)
        level[: len(leaves)] = leaves
        levels = [level]
        while len(level) > 1:
            level = level.reshape(-1, 2).sum(axis=1)
            levels.append(level)
        return [0, *np.concatenate(levels[::-1]).tolist()]

    def leaves(self) -> list[tuple[int, int]]:
        return [x for slot in self.own for x in slot]

    def _slot(self, at: int) -> tuple[int, int]:
        """The slot that holds character ``at`` (the last one with characters, beyond the end) and its start."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def _set(self, slot: int, pieces: list[tuple[int, int]]) -> None:
        self.own[slot] = pieces
        node = slot + self.width
        more, plus = sum(a for a, _ in pieces) - self.chars[node], sum(b for _, b in pieces) - self.tokens[node]
        while node and (more or plus):
            self.chars[node] += more
            self.tokens[node] += plus
            node >>= 1

    def edit(self, at: int, gone: int, new: str) -> None:
        at = max(0, min(at, len(self.text)))
        gone = max(0, min(gone, len(self.text) - at))
        end = at + gone
        first, start = self._slot(max(0, at - AHEAD))
        keep = 0
        for size, _ in self.own[first][:-1]:  # to the piece that holds the place
            if start + size > max(0, at - AHEAD):
                break
            start, keep = start + size, keep + 1
        self.text = self.text[:at] + new + self.text[end:]
        shift = len(new) - gone
        # (slot, place) and ``border`` pass over old pieces until the new text is cut at a border behind the edit
        slot, place, border, pos = first, keep, start, start
        pieces: list[tuple[int, int]] = []
        while True:
            while border < end or border + shift < pos or border == start and place == keep and slot == first:
                while slot < self.slots and place >= len(self.own[slot]):
                    slot, place = slot + 1, 0
                if slot >= self.slots:
                    break
                border += self.own[slot][place][0]
                place += 1
            if border >= end and pos == border + shift:
                break
            m = self.cut(self.text, pos)
            pieces.append((len(m[0]), self.count(m[0])))
            self.encoded += 1
            pos = m.end()
        rest = self.own[slot][place:] if slot < self.slots else []
        if slot == first:
            self._set(first, self.own[first][:keep] + pieces + rest)
        else:
            self._set(first, self.own[first][:keep] + pieces)
            for s in range(first + 1, min(slot, self.slots)):
                self._set(s, [])
            if slot < self.slots:
                self._set(slot, rest)
        if len(self.own[first]) > MANY:
            self._deal(self.leaves())


def _stored(tree: Tree) -> bytes:
    return zlib.compress(np.array(tree.leaves(), "<u4").reshape(-1, 2).T.tobytes(), 1)


def _leaves(blob) -> list[tuple[int, int]]:
    a, b = np.frombuffer(zlib.decompress(blob), "<u4").reshape(2, -1).tolist()
    return list(zip(a, b, strict=True))


def _vocabulary(df: DataFrame, path: str | None, pattern: str | None):
    """What a task needs: the broadcast vocabulary and the pattern."""
    if path is None:
        path, pattern = default_vocabulary()
    sent = df.sparkSession.sparkContext.broadcast(read(path))

    def tools():
        known = pieces_of(sent.value)
        return regex.compile(pattern), lambda p: len(known[p]) >> 2

    return tools


def trees(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text, n_tokens, tree of every row: a table to be stored."""
    tools = _vocabulary(docs, path, pattern)

    def run(batches):
        cut, count = tools()
        for b in batches:
            made = [Tree(t.as_py() or "", cut, count) for t in b.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": b.column("text"), "n_tokens": pa.array([t.tokens[1] for t in made], pa.int64()), "tree": pa.array([_stored(t) for t in made], pa.binary())})

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, text string, n_tokens long, tree binary")


def _with_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    listed = edits.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "at", "gone", "new"))).alias("_edits"))
    return rows.join(listed, F.col("doc_id") == F.col("_id"), "left").drop("_id")


def edited(stored: DataFrame, edits: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text, n_tokens, tree after the edits, and n_reencoded: the pieces that were encoded for them.

    Rows without edits pass as they are; the others' trees are read, not made from the text.
    """
    tools = _vocabulary(stored, path, pattern)

    def run(batches):
        cut, count = tools()
        for b in batches:
            out = []
            for text, n, blob, todo in zip(*(b.column(c) for c in ("text", "n_tokens", "tree", "_edits")), strict=True):
                if not todo.is_valid:
                    out.append((text.as_py(), n.as_py(), blob.as_py(), 0))
                    continue
                tree = Tree(text.as_py() or "", cut, count, _leaves(blob.as_buffer()))
                for e in todo.as_py():
                    tree.edit(e["at"] or 0, e["gone"] or 0, e["new"] or "")
                out.append((tree.text, tree.tokens[1], _stored(tree), tree.encoded))
            t, n, x, k = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(t, pa.string()), "n_tokens": pa.array(n, pa.int64()), "tree": pa.array(x, pa.binary()), "n_reencoded": pa.array(k, pa.int64())})

    rows = _with_edits(stored.select("doc_id", "text", "n_tokens", "tree"), edits)
    return mapped(rows, run, "doc_id long, text string, n_tokens long, tree binary, n_reencoded long")


def counted(docs: DataFrame, edits: DataFrame | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_edited, n_reencoded, edited_chars for every row.

    edits: doc_id, seq, at, gone, new (characters).  Without it each document gets the three of ``sample_edits``.
    """
    tools = _vocabulary(docs, path, pattern)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = base.withColumn("_edits", sample_edits()) if edits is None else _with_edits(base, edits)

    def run(batches):
        cut, count = tools()
        for b in batches:
            out = []
            for text, todo in zip(b.column("text"), b.column("_edits"), strict=True):
                tree = Tree(text.as_py() or "", cut, count)
                before = tree.tokens[1]
                for e in todo.as_py() or ():
                    tree.edit(e["at"] or 0, e["gone"] or 0, e["new"] or "")
                out.append((before, tree.tokens[1], tree.encoded, tree.chars[1]))
            a, c, d, e = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(a, pa.int64()), "n_edited": pa.array(c, pa.int64()), "n_reencoded": pa.array(d, pa.int64()), "edited_chars": pa.array(e, pa.int64())})

    return mapped(base, run, "doc_id long, n_tokens long, n_edited long, n_reencoded long, edited_chars long")


def sample_edits():
    """Three edits for any text: a replacement at a third, a deletion at two thirds, and an addition at the end."""
    n = F.coalesce(F.length("text"), F.lit(0))
    one = lambda seq, at, gone, new: F.struct(F.lit(seq).alias("seq"), at.cast("int").alias("at"), F.lit(gone).alias("gone"), F.lit(new).alias("new"))
    return F.array(one(0, F.floor(n / 3), 5, " corrected words,"), one(1, F.floor(2 * n / 3), 3, ""), one(2, n + 100, 0, "\nSeen by an editor."))


def op5_edit_counts(docs: DataFrame) -> DataFrame:
    return counted(docs)
