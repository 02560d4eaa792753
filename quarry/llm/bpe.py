"""Operator 8, byte-level BPE as a monoid: texts are encoded in halves whose token lists are joined up a tree.

Joining two encodings re-encodes the bytes of k tokens on either side of the border, k = 1, 2, 4, ..., until the new
tokens sit well with what is kept outside: two tokens sit well if encoding their bytes together gives just these two.
In a vocabulary whose tokens are made by merges of lower rank, a list of tokens is the encoding of its bytes exactly if
every token encodes to itself and every two neighbours sit well; so once both borders do, nothing outside can change.
Decoding concatenates byte strings up the same kind of tree.

The pattern that cuts a text into pieces comes first, as the vocabulary asks; equal pieces are encoded once for each
task.  Edge cases: a null or empty text has no tokens; very long pieces cost n log n; repeated rows are encoded each;
an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import mapped

#: Pieces, and pairs of tokens, kept in a worker's memory, and the longest piece.
KEPT, LONGEST = 400_000, 64
LEAF = 24


class Vocabulary:
    """Tokens and their ranks, from lines of a token in base64 and its rank."""

    def __init__(self, lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        self.token = {v: k for k, v in self.rank.items()}
        self._well: dict[tuple[int, int], bool] = {}

    def direct(self, raw: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until no pair is a token."""
        n = len(raw)
        rank = self.rank
        if n < 2:
            return [rank[raw]] if n else []
        if n <= LEAF:
            parts = [raw[i : i + 1] for i in range(n)]
            pairs = [rank.get(parts[i] + parts[i + 1], 1 << 40) for i in range(n - 1)]
            while pairs:
                low = min(pairs)
                if low == 1 << 40:
                    break
                i = pairs.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = rank.get(parts[i - 1] + parts[i], 1 << 40)
                if i < len(pairs):
                    pairs[i] = rank.get(parts[i] + parts[i + 1], 1 << 40)
            return [rank[p] for p in parts]
        end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = right[i] if end[i] else n
            if not end[i] or j >= n or end[j] != e:
                continue
            end[i], end[j], right[i] = e, 0, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := rank.get(raw[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[i]]))
            if left[i] >= 0 and (r := rank.get(raw[left[i] : e])) is not None:
                heapq.heappush(heap, (r, left[i], e))
        out, i = [], 0
        while i < n:
            out.append(rank[raw[i : end[i]]])
            i = right[i]
        return out

    def well(self, a: int, b: int) -> bool:
        if (known := self._well.get((a, b))) is None:
            if len(self._well) >= KEPT:
                self._well.clear()
            known = self._well[a, b] = self.direct(self.token[a] + self.token[b]) == [a, b]
        return known

    def join(self, a: list[int], b: list[int]) -> list[int]:
        k = 1
        while a and b:
            window = self.direct(b"".join(self.token[t] for t in a[-k:] + b[:k]))
            if (k >= len(a) or self.well(a[-k - 1], window[0])) and (k >= len(b) or self.well(window[-1], b[k])):
                return a[:-k] + window + b[k:]
            k *= 2
        return a or b

    def reduce(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF:
            return self.direct(raw)
        half = len(raw) // 2
        return self.join(self.reduce(raw[:half]), self.reduce(raw[half:]))

    def piece(self, raw: bytes) -> list[int]:
        """A piece that is a token is that token, whatever its merges give."""
        return [t] if (t := self.rank.get(raw)) is not None else self.reduce(raw)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers, encoded when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids


_loaded: dict[bytes, Pieces] = {}


def pieces_of(lines: bytes) -> Pieces:
    """A worker's pieces of a vocabulary; kept for its later tasks."""
    key = hashlib.sha256(lines).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(Vocabulary(lines))
    return _loaded[key]


def read(path: str) -> bytes:
    """The lines of a vocabulary file, read on the driver: executors get them by broadcast and need no such file."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) for every row."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    sent = docs.sparkSession.sparkContext.broadcast(read(path))

    def run(batches):
        known = pieces_of(sent.value)
        split, lookup, decode = regex.compile(pattern).findall, known.__getitem__, known.vocabulary.decode
        for b in batches:
            count, digest, back, kept = [], [], [], []
            for text in b.column("text"):
                ids = b"".join(map(lookup, split(text.as_py() or "")))
                tokens = np.frombuffer(ids, "<u4")
                count.append(len(tokens))
                digest.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(decode(tokens.tolist())).hexdigest())
                if with_ids:
                    kept.append(tokens.astype(np.int32))
            cols = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(digest, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if with_ids:
                cols["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(docs: DataFrame) -> DataFrame:
    return encode(docs, *default_vocabulary())
