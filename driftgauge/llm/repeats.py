"""Repeated byte windows by depth-limited most-significant-digit passes over suffixes.

Two windows of ``depth`` bytes are equal only if every stretch of them is, so suffixes are
ordered by one digit at a time and groups from one document alone are dropped after each:

1. Digit: the ``gram`` bytes at anchors. An anchor is a place whose gram has the smallest hash
   of all grams of some window around it; equal windows have the same anchors, so suffixes
   at other places need no order of their own. Each task combines its rows before they move.
2. Digit: all that windows around the anchor can hold. A group that agrees in it repeats every
   window there; only its smallest document goes on.
3. Digit: the windows themselves, for anchors whose groups agree in part. Equal groups are
   exactly the repeated windows.

Copies of a whole text are told by its digest beforehand; only the one with the smallest id goes
through the passes. Keys are dealt to parts by hash and move as packed arrays; what is learned about a key goes
back to the documents that asked, by their home. A task asks once for a key however often
it has it, so a text, line or passage that very many documents share is one row for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import in_pieces, ranked_in_groups, table_of, text_bytes
from driftgauge.session import settle

DEPTH, GRAM = 50, 40
#: Larger than any id: a null id counts as the largest.
NO_ID = np.iinfo(np.int64).max
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Bytes:
    """Some texts one behind another, with eight bytes at once from any place."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        raw = np.frombuffer(b"".join(texts) + bytes(DEPTH + 16), np.uint8)
        self.size = len(raw) - DEPTH - 16
        self.raw = raw
        self.words = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (self.size + DEPTH + 8,), (1,))

    def hashed(self, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
        """Hash of ``length`` (8 or more) bytes from each place."""
        h = _mixed(np.full(len(at), np.uint64(length + 1000 * seed), np.uint64))
        for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
            h = _mixed(h * _M1 + self.words[at + k])
        return h


def _slide(a: np.ndarray, width: int, f) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        a = f(a[:-have], a[have:])
        have *= 2
    return f(a[: len(a) - (width - have)], a[width - have :]) if have < width else a


def anchors(data: Bytes, depth: int = DEPTH, gram: int = GRAM) -> np.ndarray:
    """Places of the anchors: every window of ``depth`` bytes inside a text holds one, chosen by its bytes alone."""
    n = data.size
    if n < depth:
        return np.zeros(0, np.int64)
    w = data.words
    order = w[: n - gram + 1] * _M1
    order ^= order >> np.uint64(29)
    order += w[gram - 8 : n - 8 + 1] * _M2
    order ^= order >> np.uint64(32)
    order = ((order * _M3) >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    width = depth - gram + 1
    least = _slide(order, width, np.minimum)  # of the window that starts here
    inside = np.ones(len(least), bool)
    for e in data.ends[:-1]:
        inside[max(0, e - depth + 1) : e] = False
    least = np.where(inside, least, np.uint32(0))
    edge = np.zeros(width - 1, np.uint32)
    return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == order)


def reach(data: Bytes, at: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place: its text, and the bytes to its left and right (itself included) that windows around it hold."""
    text = np.searchsorted(data.ends, at, side="right")
    left = np.minimum(at - data.starts[text], depth - gram)
    right = np.minimum(data.ends[text] - at, depth)
    return text, left, right


def context_hash(data: Bytes, at, left, right, depth: int, gram: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``left`` bytes before and the ``right`` bytes from each place, and of these two numbers."""
    h = _mixed((left * 256 + right).astype(np.uint64) * _M1 + np.uint64(7 + seed))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    span = left + right
    base = at - left
    for k in range(0, depth - gram + depth, 8):
        have = np.clip(span - k, 0, 8)
        some = np.flatnonzero(have)
        if not len(some):
            break
        words = data.words[base[some] + k]
        short = have[some] < 8
        words = np.where(short, words & (full >> (np.uint64(8) * (np.uint64(8) - have[some].astype(np.uint64)))), words)
        h[some] = _mixed(h[some] * _M1 + words)
    return h


# ---- packed arrays that are dealt to parts -----------------------------------------------------------------------

#: What a row holds: keys to be compared in a part, or facts for the documents of a home.
GRAMS, CONTEXTS, FAMILIES, WINDOWS, SHARED, SEVERAL, COVERED, REGION, REMOVED = range(9)
#: Fields of each kind; ``doc`` comes first, a row's own number whose upper bits, all but ``shift``, order the documents. grams go as 32 bits of a hash, of which the part holds others.
FIELDS = {
    GRAMS: ("<i8", "<u4", "u1"),  # doc, gram, whether several documents of the run have it
    CONTEXTS: ("<i8", "<u8", "<u4", "<u4", "u1"),  # doc, context in two hashes, its place and length
    FAMILIES: ("<i8", "<u4", "<u8", "u1"),  # doc, gram, a context of it, whether the run has more contexts of it
    WINDOWS: ("<i8", "<u8", "<u4", "<u4"),  # doc, window in two hashes, place
    SHARED: ("<i8", "<u4"),  # doc, gram that other documents have
    SEVERAL: ("<i8", "<u4"),  # doc, gram with different contexts
    COVERED: ("<i8", "<u4", "u1"),  # doc, place and length of a context that a smaller document has
    REMOVED: ("<i8", "<u4", "<u4"),  # doc, start, end
}
SHORT = np.uint64((1 << 32) - 1)
PACKED = "part long, kind int, rows binary"
_PACKED = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("rows", pa.binary())])


def _encoded(column: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(column).astype(kind).tobytes()


class Deal:
    """Collects columns of rows by kind and hands them out by part, as one batch."""

    def __init__(self, parts: int):
        self.parts, self.out, self.codec = parts, [], pa.Codec("zstd", 1)

    def add(self, kind: int, key: np.ndarray, *columns: np.ndarray) -> None:
        """Rows go to the part of ``key``."""
        if not len(key):
            return
        part = (_mixed(key.astype(np.uint64)) >> np.uint64(20)) % np.uint64(self.parts)
        order = np.lexsort((columns[0], part))
        part = part[order]
        bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        columns = [c[order] for c in columns]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            # ids ascend inside a part: their differences are small numbers
            rows = [np.diff(columns[0][a:b], prepend=0).tobytes()]
            rows += [_encoded(c[a:b], t) for c, t in zip(columns[1:], FIELDS[kind][1:])]
            self.put(int(part[a]), kind, (b - a).to_bytes(8, "little") + b"".join(rows))

    def put(self, part: int, kind: int, data: bytes) -> None:
        self.out.append((part, kind, len(data).to_bytes(8, "little") + self.codec.compress(data, asbytes=True)))

    def batch(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.out), 4096):
            p, k, r = zip(*self.out[a : a + 4096])
            yield table_of(_PACKED, part=p, kind=k, rows=r)
        self.out = []


def _data(rows: bytes) -> bytes:
    return pa.decompress(rows[8:], int.from_bytes(rows[:8], "little"), codec="zstd").to_pybytes()


def _home(docs: np.ndarray) -> np.ndarray:
    return docs.view(np.uint64) if docs.dtype == np.int64 else docs.astype(np.int64).view(np.uint64)


def _unpacked(batches, kinds) -> tuple[dict[int, list[np.ndarray]], list[bytes]]:
    """All rows of a partition, as columns by kind, and the regions as they came."""
    found: dict[int, list[list[np.ndarray]]] = {k: [[] for _ in FIELDS[k]] for k in kinds}
    regions = []
    for batch in batches:
        for kind, rows in zip(batch.column("kind").to_pylist(), batch.column("rows").to_pylist()):
            if kind == REGION:
                regions.append(rows)
            elif kind in found:
                data = _data(rows)
                n, at = int.from_bytes(data[:8], "little"), 8
                for i, (column, t) in enumerate(zip(found[kind], FIELDS[kind])):
                    values = np.frombuffer(data, t, n, at)
                    at += values.nbytes
                    column.append(np.cumsum(values) if i == 0 else values)
    return {
        k: [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(columns, FIELDS[k])]
        for k, columns in found.items()
    }, regions


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each group in that order) for rows grouped by all keys but the last, ordered by all."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys[:-1]:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _spread(first: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """A group's value for each of its rows."""
    return np.repeat(values, np.diff(np.append(first, n)))


def _each(first: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its group that its document has, for rows ordered by group and document."""
    new = np.zeros(len(docs), bool)
    new[first] = True
    new[1:] |= docs[1:] != docs[:-1]
    return new


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals ordered by start."""
    if not len(starts):
        return starts, ends
    reached = np.maximum.accumulate(ends)
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > reached[:-1]]))
    return starts[first], reached[np.append(first[1:], len(starts)) - 1]


def runs_of_documents(docs, starts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of each document's intervals, in order. Places are below 2**40."""
    names, rank = np.unique(docs, return_inverse=True)
    shift = rank.astype(np.int64) << 40
    order = np.argsort(shift + starts.astype(np.int64), kind="stable")
    s, e = union((shift + starts.astype(np.int64))[order], (shift + ends.astype(np.int64))[order])
    below = (1 << 40) - 1
    return names[s >> 40], s & below, e - (s & ~np.int64(below))


def _add_removed(deal: Deal, docs, starts, ends) -> None:
    docs, starts, ends = runs_of_documents(docs, starts, ends)
    deal.add(REMOVED, _home(docs), docs, starts, ends)


def _pass_through(deal: Deal, found: dict, kinds) -> None:
    for k in kinds:
        if len(found[k][0]):
            deal.add(k, _home(found[k][0]), *found[k])


# ---- pass 1: grams at anchors ------------------------------------------------------------------------------------


def _emit_grams(parts: int, depth: int, gram: int, piece: int, run_rows: int, shift: int):
    def run(batches):
        deal, held, count = Deal(parts), [], 0

        def flush():
            h, d = (np.concatenate(x) for x in zip(*held))
            order, first = _groups(h, d)
            h, d = h[order], d[order]
            last = np.append(first[1:], len(h)) - 1
            several = d[last] >> shift != d[first] >> shift
            known = _spread(first, several, len(h))
            asked = _each(first, d) & ~known  # all rows of an id where no other id has the gram, one row where some has
            asked[first] = True
            deal.add(GRAMS, h[asked], d[asked], h[asked] & SHORT, known[asked])
            deal.add(SHARED, _home(d[known]), d[known], h[known] & SHORT)

        for batch in in_pieces(batches, "text", piece):
            data = Bytes(batch.column("text").to_pylist())
            at = anchors(data, depth, gram)
            ids = batch.column("doc").to_numpy()
            held.append((data.hashed(at, gram), ids[np.searchsorted(data.ends, at, side="right")]))
            count += len(at)
            if count > run_rows:
                flush()
                held, count = [], 0
                yield from deal.batch()
        if held:
            flush()
            yield from deal.batch()

    return run


def _compare_grams(parts: int, shift: int):
    def run(batches):
        found, _ = _unpacked(batches, (GRAMS, SHARED))
        deal = Deal(parts)
        d, h, known = found[GRAMS]
        order, first = _groups(h, d)
        d, h, known = d[order], h[order], known[order].astype(bool)
        if len(h):
            last = np.append(first[1:], len(h)) - 1
            several = (d[last] >> shift != d[first] >> shift) | np.maximum.reduceat(known, first)
            told = _spread(first, several, len(h)) & ~known
            deal.add(SHARED, _home(d[told]), d[told], h[told])
        _pass_through(deal, found, (SHARED,))
        yield from deal.batch()

    return run


def _by_document(kind: int, names: tuple[str, ...], types: tuple[str, ...]):
    """One row for each document of the partition, with its facts as packed columns; removed runs are merged."""
    out = pa.schema([("doc", pa.int64())] + [(n, pa.binary()) for n in names])

    def run(batches):
        found, _ = _unpacked(batches, (kind,))
        docs, *columns = runs_of_documents(*found[kind]) if kind == REMOVED else found[kind]
        if not len(docs):
            return
        order = np.lexsort((columns[0], docs))
        docs, columns = docs[order], [c[order] for c in columns]
        first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        for a in range(0, len(first), 5000):
            some = first[a : a + 5000]
            ends = np.append(first[a + 1 : a + 5000], first[a + 5000] if a + 5000 < len(first) else len(docs))
            lists = [[_encoded(c[s:e], t) for s, e in zip(some, ends)] for c, t in zip(columns, types)]
            yield table_of(out, doc=docs[some], **dict(zip(names, lists)))

    return run


# ---- pass 2: contexts of the anchors whose grams other documents share --------------------------------------------


def _emit_contexts(parts: int, depth: int, gram: int, piece: int, run_rows: int, shift: int):
    def run(batches):
        deal, held, count = Deal(parts), [], 0

        def flush():
            d, g, c1, c2, s, n = (np.concatenate(x) for x in zip(*held))
            order, first = _groups(c1, c2, d)
            d, g, c1, c2, s, n = (x[order] for x in (d, g, c1, c2, s, n))
            more = d >> shift > _spread(first, d[first] >> shift, len(d))
            _add_removed(deal, d[more], s[more], s[more] + n[more])
            deal.add(CONTEXTS, c1[~more], *(x[~more] for x in (d, c1, c2, s, n)))
            some = _each(first, d) & ~more
            d, g, c1 = d[some], g[some], c1[some]
            order, first = _groups(g, c1)
            d, g, c1 = d[order], g[order], c1[order]
            last = np.append(first[1:], len(g)) - 1
            known = _spread(first, c1[first] != c1[last], len(g))
            asked = ~known
            asked[first] = True
            deal.add(FAMILIES, g[asked], d[asked], g[asked] & SHORT, c1[asked], known[asked])
            deal.add(SEVERAL, _home(d[known]), d[known], g[known] & SHORT)

        for batch in _opened(batches, piece):
            data = Bytes(batch.column("text").to_pylist())
            ids = batch.column("doc").to_numpy()
            at = anchors(data, depth, gram)
            h = data.hashed(at, gram)
            bounds = np.searchsorted(at, np.append(data.starts, data.size))
            keep = np.zeros(len(at), bool)
            for i, grams in enumerate(batch.column("grams").to_pylist()):
                a, b = bounds[i], bounds[i + 1]
                keep[a:b] = np.isin(h[a:b] & SHORT, np.frombuffer(grams, "<u4"))
            at, h = at[keep], h[keep]
            text, left, right = reach(data, at, depth, gram)
            fits = left + right >= depth
            at, h, text, left, right = at[fits], h[fits], text[fits], left[fits], right[fits]
            c1, c2 = (context_hash(data, at, left, right, depth, gram, seed) for seed in (0, 1))
            held.append((ids[text], h, c1, c2 >> np.uint64(32), at - left - data.starts[text], left + right))
            count += len(at)
            raw = data.raw
            for i in np.unique(text).tolist():
                a, b = np.searchsorted(text, [i, i + 1])
                starts, ends = union(at[a:b] - left[a:b], at[a:b] + right[a:b])
                numbers = [[ids[i], len(starts), b - a], starts - data.starts[i], ends - starts, np.diff(at[a:b], prepend=data.starts[i])]
                payload = [np.asarray(x, "<i8").tobytes() for x in numbers] + [raw[s:e].tobytes() for s, e in zip(starts, ends)]
                part = (_mixed(_home(ids[i : i + 1])) >> np.uint64(20)) % np.uint64(parts)
                deal.put(int(part[0]), REGION, b"".join(payload))
            if count > run_rows:
                flush()
                held, count = [], 0
            yield from deal.batch()
        if held:
            flush()
            yield from deal.batch()

    return run


def _compare_contexts(parts: int, shift: int):
    def run(batches):
        deal, kept = Deal(parts), []

        def without_regions():
            for batch in batches:
                for p, k, r in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "rows"))):
                    if k == REGION:
                        deal.out.append((p, k, r))
                yield from deal.batch()
                kept.append(batch.filter(pa.compute.not_equal(batch.column("kind"), REGION)))

        yield from without_regions()
        found, _ = _unpacked(kept, (CONTEXTS, FAMILIES, REMOVED, SEVERAL))
        d, c1, c2, s, n = found[CONTEXTS]
        order, first = _groups(c1, c2, d)
        d, s, n = d[order], s[order], n[order]
        if len(d):
            more = d >> shift > _spread(first, d[first] >> shift, len(d))
            d, s, n = d[more], s[more], n[more]
            order = np.lexsort((s, d))
            deal.add(COVERED, _home(d[order]), d[order], s[order], n[order])
        _add_removed(deal, *found[REMOVED])
        d, g, c1, known = found[FAMILIES]
        order, first = _groups(g, c1)
        d, g, c1, known = d[order], g[order], c1[order], known[order].astype(bool)
        if len(d):
            last = np.append(first[1:], len(g)) - 1
            several = (c1[first] != c1[last]) | np.maximum.reduceat(known, first)
            told = _spread(first, several, len(g)) & ~known
            deal.add(SEVERAL, _home(d[told]), d[told], g[told])
        _pass_through(deal, found, (SEVERAL,))
        yield from deal.batch()

    return run


# ---- pass 3: the windows of anchors whose grams have several contexts ---------------------------------------------


def _pairs_in(docs: np.ndarray, keys: np.ndarray, in_docs: np.ndarray, in_keys: np.ndarray) -> np.ndarray:
    """Whether each (doc, key) is among the others."""
    if not len(in_docs) or not len(docs):
        return np.zeros(len(docs), bool)
    return np.isin(_mixed(_home(docs) * _M1 + keys), _mixed(_home(in_docs) * _M1 + in_keys))


def _emit_windows(parts: int, depth: int, gram: int, piece: int, shift: int):
    def run(batches):
        found, regions = _unpacked(batches, (REMOVED, COVERED, SEVERAL))
        deal, held = Deal(parts), []
        cov_d, cov_s, cov_n = (c.astype(np.int64) for c in found[COVERED])
        gone = (cov_d, cov_s, cov_s + cov_n)
        _add_removed(deal, *(np.concatenate(x) for x in zip(found[REMOVED], gone)))
        cov_key = (cov_s << 8 | cov_n).view(np.uint64)
        sev_d, sev_g = found[SEVERAL]
        found.clear()
        at_region = 0
        while at_region < len(regions):
            texts, docs, offsets, places, size = [], [], [], [], 0
            while at_region < len(regions) and size < piece:
                payload = _data(regions[at_region])
                doc, m, k = np.frombuffer(payload, "<i8", 3).tolist()
                starts, lengths = np.frombuffer(payload, "<i8", m, 24), np.frombuffer(payload, "<i8", m, 24 + 8 * m)
                at = np.cumsum(np.frombuffer(payload, "<i8", k, 24 + 16 * m))
                byte = 24 + 16 * m + 8 * k
                run_of = np.searchsorted(starts, at, side="right") - 1
                base = size + np.cumsum(lengths) - lengths
                places.append(base[run_of] + at - starts[run_of])
                for s, length in zip(starts.tolist(), lengths.tolist()):
                    texts.append(payload[byte : byte + length])
                    docs.append(doc)
                    offsets.append(s)
                    byte += length
                    size += length
                at_region += 1
            data, docs, offsets = Bytes(texts), np.asarray(docs, np.int64), np.asarray(offsets, np.int64)
            at = np.concatenate(places)
            text, left, right = reach(data, at, depth, gram)
            d = docs[text]
            # A covered context's windows are those of the smaller document. Others open theirs even where all
            # bytes are removed already: larger documents may ask for them.
            place = at - left - data.starts[text] + offsets[text]
            some = _pairs_in(d, data.hashed(at, gram) & SHORT, sev_d, sev_g)
            some &= ~_pairs_in(d, (place << 8 | (left + right)).view(np.uint64), cov_d, cov_key)
            low = (at - left)[some]
            high = np.minimum(at[some], at[some] + right[some] - depth)
            n = np.maximum(0, high - low + 1)
            starts = np.unique(np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            if len(starts):
                t = np.searchsorted(data.ends, starts, side="right")
                two = data.hashed(starts, depth), data.hashed(starts, depth, 1) >> np.uint64(32)
                held.append((docs[t], *two, starts - data.starts[t] + offsets[t]))
            yield from deal.batch()
        if held:
            d, k1, k2, s = (np.concatenate(x) for x in zip(*held))
            order, first = _groups(k1, k2, d)
            d, k1, k2, s = d[order], k1[order], k2[order], s[order]
            more = d >> shift > _spread(first, d[first] >> shift, len(d))
            _add_removed(deal, d[more], s[more], s[more] + depth)
            deal.add(WINDOWS, k1[~more], d[~more], k1[~more], k2[~more], s[~more])
            yield from deal.batch()

    return run


def _compare_windows(parts: int, depth: int, shift: int):
    def run(batches):
        found, _ = _unpacked(batches, (WINDOWS, REMOVED))
        deal = Deal(parts)
        d, k1, k2, s = found[WINDOWS]
        order, first = _groups(k1, k2, d)
        d, s = d[order], s[order].astype(np.int64)
        removed = found[REMOVED]
        if len(d):
            more = d >> shift > _spread(first, d[first] >> shift, len(d))
            removed = [np.concatenate(x) for x in zip(removed, (d[more], s[more], s[more] + depth))]
        _add_removed(deal, *removed)
        yield from deal.batch()

    return run


# ---- the texts without what is repeated ---------------------------------------------------------------------------


def _compressed(batches):
    out, codec = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("text", pa.binary())]), pa.Codec("zstd", 3)
    for batch in in_pieces(batches, "text", 4 << 20):
        texts = batch.column("text").to_pylist()
        yield table_of(
            out, doc=batch.column("doc"), n_bytes=[len(t) for t in texts], text=[codec.compress(t, asbytes=True) for t in texts]
        )


def _opened(batches, piece: int) -> Iterator[pa.RecordBatch]:
    """Batches of compressed texts as those of plain ones, ``piece`` bytes at most in each but for longer texts."""
    names = ["doc", "text", "grams"]
    for batch in batches:
        sizes = batch.column("n_bytes").to_pylist()
        start = size = 0
        for i in range(len(sizes) + 1):
            if i == len(sizes) or size + sizes[i] > piece and i > start:
                part = batch.slice(start, i - start)
                texts = [
                    pa.decompress(t, n, codec="zstd").to_pybytes()
                    for t, n in zip(part.column("text").to_pylist(), part.column("n_bytes").to_pylist())
                ]
                if texts:
                    yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(texts, pa.binary()), part.column("grams")], names=names)
                start, size = i, 0
            if i < len(sizes):
                size += sizes[i]


def copies_of_texts(digests: DataFrame) -> DataFrame:
    """``(doc_id, digest)`` of the rows of ``digests`` (doc_id, digest) whose whole text a smaller document has."""
    ordered = digests.select("doc_id", "digest", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc"), F.col("doc_id").isNull().alias("last"))
    place = F.struct("last", "doc")
    groups = ordered.groupBy("digest").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("most > least")
    return settle(
        ordered.join(groups, "digest").where(place > F.col("least")).select("doc_id", "digest").distinct(), "whole-copies"
    )


def numbered_rows(digests: DataFrame) -> tuple[Column, DataFrame | None, DataFrame | None, int]:
    """How rows of ``digests`` (doc_id, digest) are numbered: (number of an id, numbers of ids or None, numbers of rows or
    None, shift).

    A number is unique to a text of an id, and shifted to the right it orders the ids, null last. Ids of one text
    are their own numbers, shifted to the left; only rows of ids that have several texts are ranked to tell them apart.
    Where ids are too far apart for that, they are ranked first.
    """
    rows = digests.distinct()
    several = settle(rows.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1"), "ids-of-several-texts")
    facts = several.agg(F.count("*").alias("ids"), F.max("texts").alias("most")).first()
    if not facts["ids"]:
        return F.coalesce("doc_id", F.lit(int(NO_ID))), None, None, 0
    shift = int(facts["most"] - 1).bit_length()
    span = digests.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = (0 if x is None else x for x in (span["low"], span["high"]))
    ids = None
    if (high - low + 1).bit_length() + shift < 63:
        of_id = F.coalesce(F.col("doc_id") - low, F.lit(high - low + 1))
    else:
        every = digests.select("doc_id").distinct().withColumn("grp", F.lit(""))
        ids = settle(ranked_in_groups(every, [F.col("doc_id").asc_nulls_last()]).select("doc_id", F.col("rank").alias("of_id")), "id-numbers")
        of_id = F.col("of_id")
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    told = rows.join(several.select(F.col("doc_id").alias("id")), same, "left_semi")
    grp = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    extra = settle(ranked_in_groups(told.withColumn("grp", grp), ["digest"]).select("doc_id", "digest", F.col("rank").alias("extra")), "row-numbers")
    return of_id, ids, extra, shift


def _without(with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    out = pa.schema(fields + [("kept", pa.binary())] * with_text)

    def run(batches):
        for batch in in_pieces(batches, "text", 8 << 20):
            n, removed, spans, digests, kept = [], [], [], [], []
            for text, starts, ends, copy in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends", "copy"))):
                if copy:
                    s, rest = [0], b""
                elif starts:
                    s, e = np.frombuffer(starts, "<i8").tolist(), np.frombuffer(ends, "<i8").tolist()
                    rest = b"".join(text[a:b] for a, b in zip([0, *e], [*s, len(text)]))
                else:
                    s, rest = [], text
                n.append(len(text))
                removed.append(len(text) - len(rest))
                spans.append(len(s))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield table_of(out, doc_id=batch.column("doc_id"), n_bytes=n, n_removed=removed, n_spans=spans, kept_sha256=digests, kept=kept)

    return run


def remove_repeats(
    docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, with_text: bool = False, piece: int = 1 << 20,
    run_rows: int = 1 << 20, broadcast_rows: int = 1 << 20,
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])`` for each row of ``docs`` (doc_id, text).

    A byte is removed if a string of ``depth`` bytes that covers it also starts in a document with a smaller
    doc_id; strings don't cross documents. Null texts are empty; rows with the same id are no smaller than each
    other, each loses what it repeats itself, and a null id is larger than all others. Texts shorter than ``depth`` stay whole. What was found
    about the documents is sent to all tasks while it is about fewer than ``broadcast_rows`` documents.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 16 * partitions  # several parts to a partition even out
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).withColumn("digest", F.unhex(F.md5("text")))

    def small(df):
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    def beside(df, other, *keys):
        """``df`` with the columns of ``other``, by keys that may be null."""
        renamed = other.withColumnsRenamed({k: f"_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return df.join(small(renamed), same, "left").drop(*[f"_{k}" for k in keys])

    digests = settle(texts.where(F.octet_length("text") >= depth).select("doc_id", "digest"), "text-digests")
    copies = copies_of_texts(digests)
    of_id, ids, extra, shift = numbered_rows(digests)
    if ids is not None:
        texts = beside(texts, ids, "doc_id")
    if extra is not None:
        texts = beside(texts, extra, "doc_id", "digest")
        of_id = F.shiftleft(of_id, shift) + F.coalesce("extra", F.lit(0))
    known = beside(texts.withColumn("doc", of_id), copies.withColumn("copy", F.lit(True)), "doc_id", "digest")

    def met(df):
        return df.repartition(partitions, "part")

    long = known.where((F.octet_length("text") >= depth) & F.col("copy").isNull()).select("doc", "text")
    grams = met(long.mapInArrow(_emit_grams(parts, depth, gram, piece, run_rows, shift), PACKED)).mapInArrow(_compare_grams(parts, shift), PACKED)
    marks = settle(met(grams).mapInArrow(_by_document(SHARED, ("grams",), ("<u4",)), "doc long, grams binary"), "shared-grams")
    concerned = long
    if marks.count() <= broadcast_rows:
        concerned = long.join(F.broadcast(marks.select("doc")), "doc", "left_semi")  # so that other texts need not move
    packed = concerned.mapInArrow(_compressed, "doc long, n_bytes long, text binary")
    found = packed.join(marks.hint("merge"), "doc").select("doc", "n_bytes", "text", "grams")
    contexts = met(found.mapInArrow(_emit_contexts(parts, depth, gram, piece, run_rows, shift), PACKED)).mapInArrow(
        _compare_contexts(parts, shift), PACKED
    )
    windows = met(met(contexts).mapInArrow(_emit_windows(parts, depth, gram, piece, shift), PACKED)).mapInArrow(
        _compare_windows(parts, depth, shift), PACKED
    )
    removed = settle(
        met(windows).mapInArrow(_by_document(REMOVED, ("starts", "ends"), ("<i8", "<i8")), "doc long, starts binary, ends binary"),
        "removed-runs",
    )
    joined = known.join(small(removed), "doc", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return joined.select("doc_id", "text", "starts", "ends", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(_without(with_text), schema)
