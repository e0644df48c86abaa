"""What the operators must return, computed plainly on the driver."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def smallest_reachable(nodes, pairs):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash(text):
    words = WORD.findall((text or "").translate(UPPER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(docs):
    fps = {i: simhash(t) for i, t in docs}
    ids = sorted(fps)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (fps[a] ^ fps[b]).bit_count() <= 3]
    group = smallest_reachable(ids, pairs)
    return {(i, f"{fps[i]:016x}", group[i]) for i in ids}


def lines_kept(docs, shortest=10):
    def key(line):
        return line.strip(BLANKS).translate(UPPER)

    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = set()
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < shortest or i == min(holders[key(x)])]
        out.add((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def repeats_removed(docs, length=400):
    seen = defaultdict(int)
    for _, text in docs:
        data = (text or "").encode()
        for s in range(len(data) - length + 1):
            seen[hashlib.md5(data[s : s + length]).digest()] += 1
    out = set()
    for i, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if seen[hashlib.md5(data[s : s + length]).digest()] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.add((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
