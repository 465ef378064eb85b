"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = SPACED.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    repeated = set()
    for i, g in enumerate(zip(words, words[1:], words[2:])):
        if grams[g] > 1:
            repeated |= {i, i + 1, i + 2}
    lines, seen = 0, set()
    for x in text.split("\n"):
        if SPACED.search(x):
            lines += x in seen
            seen.add(x)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    words = SPACED.findall(lowered(text))
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near_groups(rows):
    """rows: (id, text). {row index: least reachable id}."""
    fps = [fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    arr = np.array(fps, dtype=np.uint64)
    for i in range(len(rows)):
        for j in np.nonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 2)[0]:
            up[root(i)] = root(i + 1 + int(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return fps, [least.get(root(i)) for i in range(len(rows))]


WORD5 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(text, items):
    """items: {id: text}. n_words, n_hit, sorted ids as strings."""
    words = WORD5.findall(lowered(text))
    hit, found = set(), set()
    for i, t in items.items():
        own = WORD5.findall(lowered(t))
        for w in {tuple(own[k : k + 10]) for k in range(max(1, len(own) - 9))} if own else ():
            for s in range(len(words) - len(w) + 1):
                if tuple(words[s : s + len(w)]) == w:
                    hit |= set(range(s, s + len(w)))
                    found.add(i)
    return len(words), len(hit), sorted(map(str, found))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
