"""Brute-force versions of the operators, in plain Python."""

import base64
import collections
import hashlib
import re

import numpy as np
import xxhash


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, linked):
    """Smallest key reachable, for items by position; ``linked(i, j)`` says whether two are."""
    least = [min((keys[j] for j in range(len(keys)) if (i == j or linked(i, j)) and keys[j] is not None), default=None) for i in range(len(keys))]
    near = [[j for j in range(len(keys)) if i == j or linked(i, j)] for i in range(len(keys))]
    while True:
        new = [min((least[j] for j in near[i] if least[j] is not None), default=None) for i in range(len(keys))]
        if new == least:
            return least
        least = new


def secrets(text):
    kinds = {
        "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 6),
        "access": (r"AKIA[A-Z0-9]+", 0, 20),
        "hex": (r"[0-9a-f]+", 0, 24),
    }
    out = []
    for n, (kind, (pattern, flags, least)) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or "", flags):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def contamination(texts, items, window=13):
    """``(n_words, n_hit, item ids, contaminated)`` per text; items are ``(id, text)``."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add("" if i is None else str(i))
    lengths = {len(w) for w in windows}
    for t in texts:
        w = word.findall(low(t))
        hit, ids = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        yield len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)


def ranks(path):
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}


def sha(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
