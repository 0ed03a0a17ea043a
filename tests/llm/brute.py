"""Plain versions of the operators' results, one document at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

NO_ID = 1 << 63


def fold(doc_id, of):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, bits=2):
    """rows of (doc_id, fingerprint) to {(doc_id, fingerprint): smallest id}."""
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.asarray(prints, np.uint64)
    for i, f in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= bits):
            parent[find(prints[i + 1 + int(j)])] = find(f)
    least = {}
    for d, f in rows:
        r = find(f)
        if d is not None:
            least[r] = min(d, least.get(r, NO_ID))
    return {f: least.get(find(f)) for f in prints}


def base_spans(text):
    """(start, kind number, kind, end) of the four kinds."""
    kinds = ["email", "ip", "card", "phone"]
    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    ]

    def valid(kind, value):
        digits = [int(c) for c in value if "0" <= c <= "9"]
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    return sorted(
        (m.start(), k, kind, m.end())
        for k, (kind, p) in enumerate(zip(kinds, patterns)) for m in re.finditer(p, text or "") if valid(kind, m.group())
    )


def repeats(rows, depth=50):
    """[(n_bytes, n_removed, n_spans, sha256)] of (doc_id, text) rows."""
    first = {}
    for d, t in rows:
        b, key = (t or "").encode(), NO_ID if d is None else d
        for i in range(len(b) - depth + 1):
            w = b[i : i + depth]
            if first.get(w, NO_ID + 1) > key:
                first[w] = key
    out = []
    for d, t in rows:
        b, key = (t or "").encode(), NO_ID if d is None else d
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - depth + 1):
            if first[b[i : i + depth]] < key:
                gone[i : i + depth] = True
        rest = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def unigram_scores(rows):
    """[(held_out, n_tokens, n_known, train_tokens, base_score)]."""
    counts = Counter()
    for d, t in rows:
        if fold(d, 7) != 2:
            counts.update([*words(t), None])
    total, types = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        tokens = [*words(t), None]
        out.append(
            (fold(d, 7) == 2, len(tokens), sum(counts[w] > 0 for w in tokens), total, sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in tokens))
        )
    return out


def top_k(rows, k=5):
    kept = {
        i: [math.floor(256 * float(x)) for x in v]
        for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for q in kept:
        if q % 50 == 0:
            scores = [(sum(a * b for a, b in zip(kept[q], v)), i) for i, v in kept.items() if i != q and len(v) == len(kept[q])]
            out += [(q, r, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: target} by sharing out again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, target, left = list(names), {s: 0.0 for s in names}, share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not above:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def contamination(text, items, window=13):
    """(n_words, n_hit, n_items, sha256) of a text against (item_id, text) rows."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, found = split(text), set(), set()
    places = {}
    for item, t in items:
        iw = split(t)
        for i in range(max(1, len(iw) - window + 1) if iw else 0):
            places.setdefault(tuple(iw[i : i + window]), set()).add(item)
    for n in sorted({len(p) for p in places}):
        for i in range(len(w) - n + 1):
            owners = places.get(tuple(w[i : i + n]))
            if owners:
                hit.update(range(i, i + n))
                found |= owners
    ids = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest()
