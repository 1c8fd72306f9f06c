"""Brute-force answers on small fixtures."""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text: str | None, pattern: str = r"[^\x20\x09-\x0D]+") -> list[str]:
    return re.findall(pattern, (text or "").translate(LOW))


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def classes(nodes: list, linked) -> dict:
    """Smallest node reachable from each node."""
    label = {n: n for n in nodes}
    again = True
    while again:
        again = False
        for i, a in enumerate(nodes):
            for b in nodes[i + 1 :]:
                if label[a] != label[b] and linked(a, b):
                    low = min(label[a], label[b])
                    label[a] = label[b] = low
                    again = True
    return label


def repeated(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, spans, sha256 of what is left) of each text."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def hits(text: str | None, items: dict[str, str | None], window: int) -> tuple[int, int, list[str]]:
    """(words, hit words, items) of a text."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    doc, hit, found = words(text, pattern), set(), set()
    for name, item in items.items():
        w = words(item, pattern)
        wins = [w] if 0 < len(w) < window else [w[i : i + window] for i in range(len(w) - window + 1)]
        for win in wins:
            for i in range(len(doc) - len(win) + 1):
                if doc[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(name)
    return len(doc), len(hit), sorted(found)


def words_as_are(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
