"""The first three stages of the pipeline by brute force."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, sets_and_components):
    """doc_id -> sha256 of the text after quality rules (base rules; no host of these rows is bad), copies and repeats."""
    texts = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        if len(w) >= 20 and 100 * len(cover) <= 30 * len(w):
            texts[i] = t
    _, parts = sets_and_components(texts)
    seen, out = set(), {}
    for i in sorted(i for i in texts if parts[i] == i):
        raw = texts[i].encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if (w := raw[k : k + 100]) in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
        if left:
            out[i] = hashlib.sha256(left.encode()).hexdigest()
    return out
