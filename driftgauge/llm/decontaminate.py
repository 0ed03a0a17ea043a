"""Benchmark decontamination with suffix arrays of the training texts.

Each task builds suffix arrays over the words of its shard of documents, one for about
``shard_bytes`` of text: suffixes are compared by their first ``window`` words, and only
suffixes that begin with the first words of some test suffix are ordered, as no other can
match. Every test suffix of ``window`` words, or a whole shorter item, is then searched by bisection;
the range it finds are its verbatim occurrences with their places, and occurrences of
neighbouring suffixes of an item, joined, are the longest match.
The test set goes to the tasks in blocks of bounded size; each block is another pass.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import in_pieces, table_of, text_bytes
from driftgauge.session import settle

WINDOW = 13
#: A-Z to a-z; bytes that are neither alphanumeric nor above ASCII separate words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class TestSuffixes:
    """The windows of test items as rows of word ids, ready for searching.

    ``table``: distinct windows, 0 behind short ones, in ascending order, with their ``lengths``. Rows of one item_id are one
    item; rows without an id are one, whose name is the empty text. ``owner_items`` and ``owner_places`` hold, from
    ``owner_from[k]`` on, the items that have window k (by their place in ``names``) and where in the item it begins.
    """

    __test__ = False

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window, self.vocabulary = window, {}
        numbers: dict[object, int] = {}
        owners: dict[tuple[int, ...], set[tuple[int, int]]] = {}
        shift: dict[int, int] = {}
        for item, text in items:
            k = numbers.setdefault(item, len(numbers))
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            first = shift.get(k, 0)  # texts of one item follow each other with a gap
            for s in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[s : s + window]), set()).add((k, first + s))
            shift[k] = first + len(ids) + 1
        self.names = ["" if i is None else str(i) for i in numbers]
        rows = sorted(owners)
        self.lengths = np.asarray([len(w) for w in rows], np.int64)
        self.table = np.zeros((len(rows), window), np.uint32)
        for k, w in enumerate(rows):
            self.table[k, : len(w)] = w
        held = [sorted(owners[w]) for w in rows]
        self.owner_from = np.concatenate([[0], np.cumsum([len(h) for h in held], dtype=np.int64)]).astype(np.int64)
        flat = np.asarray([o for h in held for o in h], np.int64).reshape(-1, 2)
        self.owner_items, self.owner_places = flat[:, 0], flat[:, 1]
        #: Hashes of the first words of the windows, which a suffix must have to match: by the number of words in them.
        self.heads = {n: np.unique(_head_hash(self.table[np.minimum(self.lengths, 3) == n].astype(np.uint64), n)) for n in (1, 2, 3) if n <= window}

    def owners(self, k: int) -> np.ndarray:
        return self.owner_items[self.owner_from[k] : self.owner_from[k + 1]]


def _head_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Of the first ``n`` words of each row."""
    key = np.zeros(len(words), np.uint64)
    for i in range(n):
        key = key * np.uint64(0x9E3779B97F4A7C15) + words[:, i] + np.uint64(1)
    return key


def _in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _as_strings(table: np.ndarray) -> np.ndarray:
    """Rows of word ids as byte strings in the same order."""
    return np.ascontiguousarray(table.astype(">u4")).view(f"S{4 * table.shape[1]}").ravel()


class SuffixArray:
    """Suffixes of the shard's words, ordered by their first ``window`` words; documents are parted by 0."""

    def __init__(self, words: np.ndarray, tests: TestSuffixes):
        w = np.concatenate([words, np.zeros(tests.window, np.int64)])
        at = np.flatnonzero(words)
        keep = np.zeros(len(at), bool)
        for n, heads in tests.heads.items():
            if len(heads):
                keep |= _in_sorted(_head_hash(np.stack([w[at + i] for i in range(n)], axis=1).astype(np.uint64), n), heads)
        at = at[keep]
        keys = _as_strings(w[at[:, None] + np.arange(tests.window)])
        order = np.argsort(keys, kind="stable")
        self.order, self.keys = at[order], keys[order]

    def find(self, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """For each window of the test the range of suffixes that begin with it, all by bisection at once."""
        beyond = np.where(np.arange(tests.window) < tests.lengths[:, None], tests.table, np.uint32(0xFFFFFFFF))
        low = np.searchsorted(self.keys, _as_strings(tests.table), "left")
        high = np.searchsorted(self.keys, _as_strings(beyond), "right")
        return low, high


def match_documents(texts: list[bytes], tests: TestSuffixes) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
    """Number of words of each text, and its matches: (first words, places in ``tests.table``), in the order of the text."""
    get = tests.vocabulary.get
    ids, counts = [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        ids.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
        ids.append(np.zeros(1, np.int64))
    array = SuffixArray(np.concatenate(ids) if ids else np.zeros(0, np.int64), tests)
    starts = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64) + 1)]).astype(np.int64)
    low, high = array.find(tests)
    which = np.repeat(np.arange(len(low)), high - low)
    at = array.order[np.arange(len(which)) - np.repeat(np.cumsum(high - low) - high, high - low)]
    order = np.lexsort((which, at))
    at, which = at[order], which[order]
    cuts = np.searchsorted(at, starts)
    return counts, [(at[a:b] - s, which[a:b]) for a, b, s in zip(cuts, cuts[1:], starts)]


def longest_match(starts: np.ndarray, which: np.ndarray, tests: TestSuffixes) -> dict | None:
    """The longest stretch of a text that stands in an item word for word: neighbouring windows of an item are one.

    Of equally long ones the first in the text, then that of the smallest name. The time is that of the windows
    found times the items that have them.
    """
    sizes = tests.owner_from[which + 1] - tests.owner_from[which]
    if not sizes.sum():
        return None
    at = np.arange(sizes.sum()) + np.repeat(tests.owner_from[which] - np.cumsum(sizes) + sizes, sizes)
    start, item = np.repeat(starts, sizes), tests.owner_items[at]
    diagonal, words = start - tests.owner_places[at], np.repeat(tests.lengths[which], sizes)
    order = np.lexsort((start, diagonal, item))
    start, item, diagonal, words = start[order], item[order], diagonal[order], words[order]
    new = np.ones(len(start), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (start[1:] > start[:-1] + words[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    length = start[last] + words[last] - start[first]
    most = first[length == length.max()]
    s, name = min((int(start[i]), tests.names[item[i]]) for i in most)
    return {"start": s, "words": int(length.max()), "item_id": name}


def runs(intervals: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (first word, words) of the intervals' union."""
    out: list[list[int]] = []
    for s, n in sorted(intervals):
        if out and s <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n - out[-1][0])
        else:
            out.append([s, n])
    return [(s, n) for s, n in out]


def digest(items: Iterable) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items)).encode()).hexdigest()


REPORT = (
    "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, "
    "places array<struct<start: long, words: long, item_id: string>>, longest struct<start: long, words: long, item_id: string>"
)
_PLACE = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("item_id", pa.string())])
_REPORT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64())]
    + [("items", pa.list_(pa.string())), ("items_sha256", pa.string()), ("places", pa.list_(_PLACE)), ("longest", _PLACE)]
)
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))


def _scan(tests: TestSuffixes, shard_bytes: int, with_places: bool, numbered: bool):
    """Reports of one block of items; ``numbered`` ones carry the row and the runs of words that are hit."""
    out = pa.schema([*([("row", pa.int64()), ("hits", _HITS)] if numbered else []), *_REPORT])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text", shard_bytes):
            counts, found = match_documents(batch.column("text").to_pylist(), tests)
            items, hits, places, longest = [], [], [], []
            for starts, which in found:
                some = np.unique(which)
                numbers = np.unique(np.concatenate([tests.owners(k) for k in some])) if len(some) else []
                items.append(sorted(tests.names[o] for o in numbers))
                hits.append(runs(zip(starts.tolist(), tests.lengths[which].tolist())))
                if not with_places:
                    places.append(None)
                    longest.append(None)
                    continue
                places.append(
                    [
                        {"start": s, "words": int(tests.lengths[k]), "item_id": tests.names[o]}
                        for s, k in zip(starts.tolist(), which.tolist()) for o in np.unique(tests.owners(k))
                    ]
                )
                longest.append(longest_match(starts, which, tests))
            more = {"row": batch.column("row"), "hits": [[{"start": s, "words": n} for s, n in h] for h in hits]} if numbered else {}
            yield table_of(
                out, **more, doc_id=batch.column("doc_id"), n_words=counts, n_hit=[sum(n for _, n in h) for h in hits],
                n_items=[len(i) for i in items], items=items, items_sha256=[digest(i) for i in items], places=places, longest=longest,
            )

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row's reports of all blocks as one; no item is in two blocks."""
    items = sorted(i for x in pdf["items"] for i in x)
    hits = runs((h["start"], h["words"]) for x in pdf["hits"] for h in x)
    known = [list(x) for x in pdf["places"] if x is not None]
    places = sorted((p for x in known for p in x), key=lambda p: (p["start"], p["words"], p["item_id"]))
    longest = min((p for p in pdf["longest"] if p is not None), key=lambda p: (-p["words"], p["start"], p["item_id"]), default=None)
    return pd.DataFrame(
        {
            "doc_id": pdf["doc_id"].iloc[:1].astype("Int64"), "n_words": pdf["n_words"].iloc[:1],
            "n_hit": [sum(n for _, n in hits)], "n_items": [len(items)], "items": [items], "items_sha256": [digest(items)],
            "places": [places if known else None], "longest": [longest],
        }
    )


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = 2 << 20, block_bytes: int = 8 << 20,
    with_places: bool = True,
) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): ``doc_id, n_words, n_hit, n_items, items, items_sha256, places, longest``.

    ``n_hit`` counts the words inside occurrences of any ``window`` consecutive words of an item of
    ``benchmark`` (item_id, text); a shorter item is one window, one without words none. ``places`` are the
    occurrences, one for each item that has the window, and ``longest`` is the longest verbatim match; both are null unless
    ``with_places``. Null texts have no words. Rows of one item_id are one item; rows without an id are one too,
    named by the empty text. An empty benchmark hits nothing.

    Items come in blocks of about ``block_bytes``, by a hash of their id. One block at a time is on the driver and
    in the tasks, and its reports are written before the next; each block is a pass over the documents, and
    a row number written with these puts the reports of several blocks together.
    """
    items = settle(benchmark.select("item_id", text_bytes().alias("text")), "benchmark-items")
    size = items.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    blocks = max(1, min(math.ceil((size["bytes"] or 0) / block_bytes), size["rows"]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))

    def block(b: int) -> TestSuffixes:
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        return TestSuffixes(sorted(((r.item_id, bytes(r.text)) for r in rows), key=lambda x: (x[0] is not None, str(x[0]), x[1])), window)

    if blocks == 1:
        return texts.mapInArrow(_scan(block(0), shard_bytes, with_places, False), REPORT)
    numbered = settle(texts.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
    schema = "row long, hits array<struct<start: long, words: long>>, " + REPORT
    whole = None
    for b in range(blocks):
        part = settle(numbered.mapInArrow(_scan(block(b), shard_bytes, with_places, True), schema), "block-reports")
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("row").applyInPandas(_merge, REPORT)


def contaminated(report: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``contaminated``: at least one word in ``share`` is hit."""
    return report.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
