"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a byte string is the only chain of tokens in which every two neighbours, encoded
as one string, come out as these two tokens again. So each prefix of a piece has exactly one last
token: a token that ends there and is compatible with the last token of what stands before it.
These last tokens are kept; the ids of a piece are read off backwards, appending goes on where the
piece ended, and after an edit only the prefixes up to the place where old and new last tokens
agree over the length of the longest token are computed again.
"""

from __future__ import annotations

import base64
import gc
import itertools
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import in_pieces, kept_in_worker, table_of

#: Texts of more characters are cut into matches bit by bit.
LONG_TEXT = 1 << 20
#: Matches of more characters aren't remembered.
LONG_PIECE = 48
#: White space as the pattern's ``\s`` has it: fixed values.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Coarser matches for patterns that always part before white space behind other characters, and take at most
#: one blank together with what follows it; each is remembered as a whole.
SPACED_WORDS = f"[ ]?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Marks of prefixes that have no last token yet, and of the place before a piece.
OPEN, BEGIN = 0xFFFFFFFF, 0xFFFFFFFE


class Ranks:
    """A rank file: lines of a token in base 64 and its id, which is also its rank in merging.

    All 256 single bytes must be tokens. ``pattern`` cuts a text into the matches that are encoded separately.
    """

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank), default=1)
        #: Finds the tokens that end at each byte, the longest first; only tokens that merging can reach.
        self.endings = ahocorasick.Automaton()
        for t, r in self.rank.items():
            if self.merged(t) == [t]:
                self.endings.add_word(t.decode("latin-1"), (len(t), r))
        self.endings.make_automaton()
        self.pattern = regex.compile(pattern)
        self._fit: dict[int, bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """The tokens of a short string by merging: the neighbours of lowest joint rank first, the leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.rank.get
        joint = [get(a + b, OPEN) for a, b in zip(parts, parts[1:])]
        while joint:
            least = min(joint)
            if least == OPEN:
                break
            i = joint.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joint[i]
            if i:
                joint[i - 1] = get(parts[i - 1] + parts[i], OPEN)
            if i < len(joint):
                joint[i] = get(parts[i] + parts[i + 1], OPEN)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, encoded as one string, are these two again."""
        a, b = self.token[left], self.token[right]
        found = a + b not in self.rank and self.merged(a + b) == [a, b]
        if len(self._fit) > 1 << 20:
            self._fit.clear()
        self._fit[left << 32 | right] = found
        return found

    def fill(self, last: list[int] | array, text: str, done: int, until=None) -> int:
        """Sets ``last`` of the bytes of ``text`` (latin-1) from ``done`` on, up to one for which ``until`` is true;
        returns where it stopped.

        ``last`` is OPEN there; a character beyond latin-1 parts two pieces, and its place holds BEGIN.
        """
        known, compatible = self._fit.get, self.compatible
        for end, (length, t) in self.endings.iter(text, max(0, done - self.longest)):
            if last[end] != OPEN:
                continue
            before = last[end - length] if end >= length else BEGIN
            if before != BEGIN:
                fits = known(before << 32 | t)
                if not (compatible(before, t) if fits is None else fits):
                    continue
            last[end] = t
            if until is not None and until(end):
                return end + 1
        return len(text)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of many pieces; those that are a token as a whole are that token."""
        out = [self.rank.get(p) for p in pieces]
        others = [p.decode("latin-1") for p, t in zip(pieces, out) if t is None]
        text = "\u0100".join(others)
        last = [OPEN] * len(text) if len(text) < LONG_TEXT else array("I", [OPEN]) * len(text)
        at = -1
        for p in others[:-1]:
            at += len(p) + 1
            last[at] = BEGIN
        self.fill(last, text, 0)
        ids, end = [], -1
        for p in others:
            end += len(p)
            ids.append(self._chain(last, end, len(p)))
            end += 1
        rest = iter(ids)
        return [next(rest) if t is None else [t] for t in out]

    def encode_piece(self, piece: bytes) -> list[int]:
        return self.encode_pieces([piece])[0]

    def _chain(self, last: list[int] | array, end: int, length: int) -> list[int]:
        """The tokens of the piece of ``length`` bytes that ends at ``end``, read off backwards."""
        out, stop, token = [], end - length, self.token
        while end > stop:
            out.append(last[end])
            end -= len(token[out[-1]])
        return out[::-1]

    def cut(self, text: str, pattern=None) -> Iterator[list[str]]:
        """The matches of a text in order, a bounded number at a time."""
        pattern = pattern or self.pattern
        if len(text) <= LONG_TEXT:
            yield pattern.findall(text)
            return
        matches = (m.group() for m in pattern.finditer(text))
        while some := list(itertools.islice(matches, 1 << 16)):
            yield some


class Prefixes:
    """The last token of every prefix of one piece."""

    def __init__(self, ranks: Ranks, piece: bytes = b""):
        self.ranks, self.piece, self.last = ranks, b"", array("I")
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Goes on behind the piece's end; nothing before it is looked at but the longest token's length."""
        self.replace(len(self.piece), len(self.piece), more)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` for the bytes from ``start`` to ``end``; returns how many prefixes were computed again."""
        old, moved = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = old[:start] + array("I", [OPEN]) * (len(self.piece) - start)
        agreed = 0

        def settled(i: int) -> bool:
            nonlocal agreed
            if i >= start + len(new):
                agreed = agreed + 1 if self.last[i] == old[i - moved] else 0
            return agreed == self.ranks.longest

        stop = self.ranks.fill(self.last, self.piece.decode("latin-1"), start, settled if end < len(old) else None)
        self.last[stop:] = old[stop - moved :]
        return stop - start

    def ids(self) -> list[int]:
        """The encoding, read off from the end. A piece that is a token as a whole is that token."""
        whole = self.ranks.rank.get(self.piece)
        return self.ranks._chain(self.last, len(self.piece) - 1, len(self.piece)) if whole is None else [whole]


class EncodedText:
    """A text with its matches and their ids, that can be appended to and edited; for texts that change often."""

    def __init__(self, ranks: Ranks, text: str = ""):
        self.ranks, self.text = ranks, text
        self.pieces = [p for some in ranks.cut(text) for p in some]
        self.codes = [ranks.encode_piece(p.encode()) for p in self.pieces]

    def ids(self) -> list[int]:
        return [i for c in self.codes for i in c]

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Puts ``new`` for the characters from ``start`` to ``end``; returns how many matches were encoded again.

        A match looks at two characters behind its end at most, and what follows a boundary depends on the text
        behind it alone: matches well before the edit stay, and from the first common boundary behind it all do.
        """
        pieces, codes, at, keep = self.pieces, self.codes, 0, 0
        while keep < len(pieces) and at + len(pieces[keep]) + 2 <= start:
            at += len(pieces[keep])
            keep += 1
        moved = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        old, place = keep, at  # the first old match not passed yet, and where it begins in the old text
        fresh = []
        for m in self.ranks.pattern.finditer(self.text, at):
            here = m.start() - moved
            while old < len(pieces) and place < here:
                place += len(pieces[old])
                old += 1
            if place == here and here >= end and old < len(pieces):
                break
            fresh.append(m.group())
        else:
            old = len(pieces)
        known = dict(zip(pieces[keep:old], codes[keep:old]))
        again = [known.get(p) for p in fresh]
        encoded = [self.ranks.encode_piece(p.encode()) if c is None else c for p, c in zip(fresh, again)]
        self.pieces[keep:old], self.codes[keep:old] = fresh, encoded
        return sum(c is None for c in again)


def ranks_in_worker(path: str, pattern: str) -> Ranks:
    return kept_in_worker(("ranks", path, pattern), lambda: Ranks(path, pattern))


class Remembered:
    """Ids of the matches seen of late, in two generations of at most ``limit`` entries.

    With ``coarse`` whole words between white space are remembered, whatever the pattern makes of them.
    """

    def __init__(self, ranks: Ranks, coarse: str | None = None, limit: int = 200_000):
        self.ranks, self.limit = ranks, limit
        self.coarse = re.compile(coarse) if coarse else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def code(self, piece: str) -> bytes:
        return np.asarray(self.ranks.encode_piece(piece.encode()), "<u4").tobytes()

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Codes of matches not known yet; those too long to keep are only in the returned table."""
        young, old, codes = self.young, self.old, {}
        parts = {p: self.ranks.pattern.findall(p) for p in new} if self.coarse else {p: [p] for p in new}
        fresh = list({q for some in parts.values() for q in some if q not in young and q not in old})
        encoded = self.ranks.encode_pieces([q.encode() for q in fresh])
        codes = {q: struct.pack(f"<{len(ids)}I", *ids) for q, ids in zip(fresh, encoded)}
        long = {}
        for p, some in parts.items():
            value = b"".join([codes[q] if q in codes else young[q] if q in young else old[q] for q in some])
            (young if len(p) <= LONG_PIECE else long)[p] = value
        if self.coarse:
            young.update((q, v) for q, v in codes.items() if len(q) <= LONG_PIECE)
        return long

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of a bounded number of texts; a long one goes through bit by bit."""
        short = [self.ranks.cut(t, self.coarse) if len(t) > LONG_TEXT else None for t in texts]
        cuts = [next(self.ranks.cut(t, self.coarse)) if s is None else None for t, s in zip(texts, short)]
        long = self._new(set().union(*(c for c in cuts if c is not None)))
        out = []
        for pieces, some in zip(cuts, short):
            if some is None:
                out.append(self._joined(pieces, long))
            else:
                out.append(b"".join([self._joined(p, self._new(set(p))) for p in some]))
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return out

    def _new(self, pieces: set[str]) -> dict[str, bytes]:
        young, old, new = self.young, self.old, []
        for p in pieces.difference(young):
            if p in old:
                young[p] = old[p]
            else:
                new.append(p)
        return self.learn(new) if new else {}

    def _joined(self, pieces: list[str], long: dict[str, bytes]) -> bytes:
        young = self.young
        if long:
            return b"".join([young[p] if p in young else long[p] for p in pieces])
        return b"".join(map(young.__getitem__, pieces))


def memory_in_worker(path: str, pattern: str, coarse: str | None) -> Remembered:
    return kept_in_worker(("encoded", path, pattern, coarse), lambda: Remembered(ranks_in_worker(path, pattern), coarse))


def _encode(path: str, pattern: str, coarse: str | None):
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        memory = memory_in_worker(path, pattern, coarse)
        gc.disable()  # nothing here makes cycles, and the collector would walk through the memory again and again
        for batch in in_pieces(batches, "text", 1 << 20):
            ids = memory.encode(batch.column("text").to_pylist())
            yield table_of(out, doc_id=batch.column("doc_id"), n_tokens=[len(i) // 4 for i in ids], ids=ids)

    return run


ENCODED = "doc_id long, n_tokens long, ids binary"


def encode(docs: DataFrame, path: str, pattern: str, coarse: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of ``docs`` (doc_id, text): ids are little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded separately by the ranks of the file ``path``; there are no special tokens.
    ``coarse``, as :data:`SPACED_WORDS`, is a pattern each of whose matches is made of whole matches of ``pattern``
    and would be cut alike if it stood alone; it saves most of the cutting.
    One row for each row: null and empty texts have no ids, null and repeated doc_ids are kept, other columns
    are dropped. A text needs about six times its size in a task, a single match without end 4 bytes a byte more.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_encode(path, pattern, coarse), ENCODED)


def _decode(path: str, pattern: str):
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches):
        tokens = ranks_in_worker(path, pattern).token
        table = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
        for batch in in_pieces(batches, "ids", 1 << 20):
            decoded = [b"".join(map(table.__getitem__, np.frombuffer(b, "<u4").tolist())) for b in batch.column("ids").to_pylist()]
            columns = {n: batch.column(n) for n in ("doc_id", "n_tokens", "ids")}
            yield table_of(out, **columns, decoded=decoded)

    return run


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with ``decoded``: the bytes of the tokens one behind the other. An id that
    is no token stops the job."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decode(path, pattern), ENCODED + ", decoded binary")


EDITED = "doc_id long, text string, n_tokens long, ids binary, encoded_again long"


def edited_ids(ranks: Ranks, text: str, ids: np.ndarray, edits: list[tuple[int, int, str]], code: Callable[[str], bytes]) -> tuple[str, bytes, int]:
    """(new text, its ids, matches encoded again) of a text with known ids; edits are (start, end, new text) in
    characters of the old text, in order and apart."""
    spans, at, pieces = [], 0, []
    for a, b, new in edits:  # the new text, and where old text stands in it
        spans.append((len("".join(pieces)), text[at:a], at))
        pieces += [text[at:a], new]
        at = b
    spans.append((len("".join(pieces)), text[at:], at))
    new_text = "".join(pieces) + text[at:]
    starts, ends, place = {}, {}, 0  # byte places of the old boundaries
    for some in ranks.cut(text):
        for p in some:
            starts[place] = len(p)
            place += len(p)
    offsets = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]) if not text.isascii() else None
    token_ends = np.cumsum([len(ranks.token[i]) for i in ids.tolist()])
    out, again, k, place = [], 0, 0, 0
    for some in ranks.cut(new_text):
        for p in some:
            while k + 1 < len(spans) and place >= spans[k + 1][0]:
                k += 1
            first, kept, origin = spans[k]
            before = place - first + origin
            if place >= first and place + len(p) <= first + len(kept) and starts.get(before) == len(p):
                a, b = (before, before + len(p)) if offsets is None else (offsets[before], offsets[before + len(p)])
                i, j = np.searchsorted(token_ends, [a, b], side="right")
                out.append(ids[i:j].astype("<u4").tobytes())
            else:
                out.append(code(p))
                again += 1
            place += len(p)
    return new_text, b"".join(out), again


def _edit(path: str, pattern: str):
    out = pa.schema(
        [("doc_id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("encoded_again", pa.int64())]
    )

    def run(batches):
        memory = memory_in_worker(path, pattern, None)
        for batch in in_pieces(batches, "text", 1 << 20):
            for row in batch.to_pylist():
                edits = [(e["start"], e["end"], e["new"] or "") for e in row["edits"] or []]
                text, ids, again = edited_ids(memory.ranks, row["text"], np.frombuffer(row["ids"], "<u4"), edits, memory.code)
                yield table_of(out, doc_id=[row["doc_id"]], text=[text], n_tokens=[len(ids) // 4], ids=[ids], encoded_again=[again])

    return run


def apply_edits(docs: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, text, n_tokens, ids, encoded_again)`` of ``docs`` (doc_id, text, ids) after ``edits`` (doc_id, start, end,
    new): characters from start to end of the old text become ``new``. Edits of a document must not overlap; one at
    the text's end appends.

    Only matches near an edit are encoded again (``encoded_again`` counts them), the others keep their ids. Documents
    without an edit and edits without a document are left out of the result's changes: the former stay as they
    are, the latter have no row. Null ids have no edits; a null text is empty.
    """
    of_each = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "new"))).alias("edits")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "ids")
    return texts.join(of_each, "doc_id", "left").mapInArrow(_edit(path, pattern), EDITED)
