"""Exact ranked lexical search on FP-trees of documents.

The terms of a block of items are ordered by how many documents hold them. Each document is restricted to
these terms; its term frequencies in that order are a path, and documents with a common beginning
share it in a tree. Every node knows, for each term below it, the highest term frequency, and the least
length norm ``m``: together they bound the score of all its documents. For one item the tree is
searched depth first, the child with the highest bound first, and what can't reach the item's k-th score
so far is not entered. The documents of a leaf are scored exactly.

Trees are built in the tasks, of a bounded number of documents of similar length each; the best of all tasks
meet by item. The items come in blocks of a bounded number of terms; each block is another pass over the documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.llm.common import in_pieces, table_of, text_bytes
from driftgauge.llm.decontaminate import WORD_BYTES
from driftgauge.session import settle

#: Floating-point sums of integers are exact up to here.
EXACT = 1 << 53
#: Stands for a null id, behind all others.
NO_ID = (1 << 63) - 1


def term_lists(text: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in order, about ``limit`` bytes of it at a time."""
    start = 0
    while start < len(text):
        some, size = text[start : start + limit].translate(WORD_BYTES), limit
        while start + size < len(text) and b" " not in some:  # a term longer than all this
            some, size = some + text[start + size : start + size + limit].translate(WORD_BYTES), size + limit
        end = len(some) if start + len(some) >= len(text) else some.rindex(b" ") + 1
        yield some[:end].split()
        start += end


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied with: grows with the frequency and falls with the document's length."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def term_weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def norms(n_terms: np.ndarray, n_documents: int, all_terms: int) -> np.ndarray:
    """``m`` of documents with ``n_terms`` terms."""
    if 25 * int(n_terms.max(initial=0)) * n_documents < 1 << 63:
        return 75 + 25 * n_terms * n_documents // max(all_terms, 1)
    return np.asarray([75 + 25 * int(n) * n_documents // all_terms for n in n_terms], np.int64)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one behind the other."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


@dataclass
class Item:
    """Terms of one item as their places in the frequency order, ascending, with weight times repeats."""

    terms: np.ndarray
    weights: np.ndarray


class DocumentTree:
    """The FP-tree of some documents.

    ``ptr``, ``terms``, ``tf``: each document's terms, ascending in the frequency order; none may be empty.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, ptr: np.ndarray, terms: np.ndarray, tf: np.ndarray, leaf: int = 16):
        packed, cuts = terms.astype(">u4").tobytes(), (4 * ptr).tolist()
        order = np.asarray(sorted(range(len(ids)), key=lambda i: packed[cuts[i] : cuts[i + 1]]), np.int64)
        places = _ranges(ptr[order], ptr[order + 1])
        self.ids, self.m, self.terms, self.tf = ids[order], m[order], terms[places], tf[places]
        self.ptr = np.concatenate([[0], np.cumsum(np.diff(ptr)[order])])
        self._grow(leaf)
        self._bound()
        self.factor = saturation(self.tf, np.repeat(self.m, np.diff(self.ptr)))

    def _grow(self, leaf: int) -> None:
        """Nodes as ranges of documents; neighbouring children of few documents are one leaf."""
        ptr, terms, sizes = self.ptr, self.terms, np.diff(self.ptr)
        self.children, self.range, self.parent = [[]], [(0, len(self.ids))], [-1]
        todo = [0]
        while todo:
            node = todo.pop()
            lo, hi = self.range[node]
            if hi - lo <= leaf:
                continue
            a, b = terms[ptr[lo] : ptr[lo + 1]], terms[ptr[hi - 1] : ptr[hi]]
            n = min(len(a), len(b))
            other = np.flatnonzero(a[:n] != b[:n])
            depth = int(other[0]) if len(other) else n  # the path all its documents share
            heads = np.full(hi - lo, -1, np.int64)  # -1: the path ends here
            longer = np.flatnonzero(sizes[lo:hi] > depth)
            heads[longer] = terms[ptr[lo + longer] + depth]
            cuts = [0, *(np.flatnonzero(np.diff(heads)) + 1).tolist(), hi - lo]
            if len(cuts) == 2:  # equal vectors
                cuts = [*range(0, hi - lo, leaf), hi - lo]
            start = 0
            for i in range(1, len(cuts)):
                if i + 1 < len(cuts) and cuts[i + 1] - start <= leaf:
                    continue  # the next child still fits into this leaf
                self.children[node].append(len(self.range))
                todo.append(len(self.range))
                self.range.append((lo + start, lo + cuts[i]))
                self.children.append([])
                self.parent.append(node)
                start = cuts[i]

    def _bound(self) -> None:
        """For each node and term below it, the saturation of the highest frequency at the least norm; by term."""
        nodes = np.asarray([i for i, c in enumerate(self.children) if not c], np.int64)
        spans = np.asarray(self.range, np.int64)
        nodes = nodes[np.argsort(spans[nodes, 0])]
        parent = np.asarray(self.parent, np.int64)
        least = np.full(len(parent), np.iinfo(np.int64).max)
        of_doc = np.repeat(nodes, np.diff(spans[nodes], axis=1)[:, 0])
        np.minimum.at(least, of_doc, self.m)
        level = (np.repeat(of_doc, np.diff(self.ptr)), self.terms, self.tf)
        found = []
        width = int(self.terms.max(initial=0)) + 1
        while len(level[0]):
            key = level[0] * width + level[1]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            node, term = np.divmod(key[first], width)
            most = np.maximum.reduceat(level[2][order], first)
            found.append((node, term, most))
            up = parent[node]
            inner = up >= 0
            level = (up[inner], term[inner], most[inner])
        for node in range(len(parent) - 1, 0, -1):  # parents come before their children
            least[parent[node]] = min(least[parent[node]], least[node])
        # a node meets its leaves' terms at several levels where they lie at several depths
        node, term, most = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((node, term))
        key = term[order] * len(parent) + node[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.bound_term, self.bound_node = np.divmod(key[first], len(parent))
        self.bound_factor = saturation(np.maximum.reduceat(most[order], first), least[self.bound_node])

    def bounds(self, item: Item) -> np.ndarray:
        """What no document below each node can exceed."""
        at = _ranges(*(np.searchsorted(self.bound_term, item.terms, side) for side in ("left", "right")))
        weight = np.zeros(len(at), np.int64) if not len(at) else item.weights[np.searchsorted(item.terms, self.bound_term[at])]
        if int(item.weights.sum()) * 1_000_000 < EXACT:
            return np.bincount(self.bound_node[at], weight * self.bound_factor[at], len(self.range)).astype(np.int64)
        out = np.zeros(len(self.range), np.int64)
        np.add.at(out, self.bound_node[at], weight * self.bound_factor[at])
        return out

    def search(self, item: Item, weight_of: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Puts the documents that belong to the ``k`` best into the heap ``best`` of (score, -id); returns how many
        leaves were entered. ``weight_of``: the item's weight of every term, 0 for those it lacks."""
        bound, entered = self.bounds(item).tolist(), 0
        stack = [0]
        while stack:
            node = stack.pop()
            if bound[node] < (best[0][0] if len(best) == k else 1):
                continue
            if self.children[node]:
                stack += sorted(self.children[node], key=bound.__getitem__)
                continue
            entered += 1
            lo, hi = self.range[node]
            a, b = self.ptr[lo], self.ptr[hi]
            scores = np.add.reduceat(weight_of[self.terms[a:b]] * self.factor[a:b], self.ptr[lo:hi] - a)
            for i in np.flatnonzero(scores >= (best[0][0] if len(best) == k else 1)).tolist():
                found = (int(scores[i]), -int(self.ids[lo + i]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return entered


def _item_terms(batches):
    out = pa.schema([("item_id", pa.int64()), ("term", pa.string()), ("times", pa.int64())])
    for batch in in_pieces(batches, "text", 1 << 20):
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            for words in term_lists(text):
                counts = Counter(words)
                yield table_of(out, item_id=[item] * len(counts), term=[w.decode() for w in counts], times=list(counts.values()))


VECTORS = "doc_id long, n_terms long, terms binary, tf binary"


def _restricted(numbers: dict[bytes, int]):
    out = pa.schema([("doc_id", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.binary()), ("tf", pa.binary())])

    def run(batches):
        get = numbers.get
        for batch in in_pieces(batches, "text", 1 << 20):
            total, terms, tf = [], [], []
            for text in batch.column("text").to_pylist():
                n, counts = 0, Counter()
                for words in term_lists(text):
                    n += len(words)
                    counts.update(map(get, words))
                counts.pop(None, None)
                total.append(n)
                terms.append(np.fromiter(counts.keys(), "<i4", len(counts)).tobytes())
                tf.append(np.fromiter(counts.values(), "<i8", len(counts)).tobytes())
            yield table_of(out, doc_id=batch.column("doc_id"), n_terms=total, terms=terms, tf=tf)

    return run


def _document_frequencies(n_numbers: int):
    out = pa.schema([("number", pa.int64()), ("df", pa.int64())])

    def run(batches):
        df = np.zeros(n_numbers, np.int64)
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4")
            df += np.bincount(found, minlength=n_numbers)
        present = np.flatnonzero(df)
        yield table_of(out, number=present, df=df[present])

    return run


def trees_of(batches, place: np.ndarray, n_documents: int, all_terms: int, tree_documents: int, held_documents: int = 1 << 13, held_terms: int = 1 << 20):
    """Trees of the documents of ``batches``: those held together are cut by their length."""
    held, n_held = [], 0

    def grown():
        ids, n, terms, tf = zip(*held)
        sizes = np.asarray([len(t) // 4 for t in terms])
        ids, n = np.asarray([NO_ID if i is None else i for i in ids], np.int64), np.asarray(n, np.int64)
        terms, tf = place[np.frombuffer(b"".join(terms), "<i4")], np.frombuffer(b"".join(tf), "<i8")
        rows = np.repeat(np.arange(len(ids)), sizes)
        within = np.lexsort((terms, rows))
        terms, tf, ptr = terms[within], tf[within], np.concatenate([[0], np.cumsum(sizes)])
        m = norms(n, n_documents, all_terms)
        by_length = np.argsort(n, kind="stable")
        for a in range(0, len(ids), tree_documents):
            some = by_length[a : a + tree_documents]
            at = _ranges(ptr[some], ptr[some + 1])
            yield DocumentTree(ids[some], m[some], np.concatenate([[0], np.cumsum(sizes[some])]), terms[at], tf[at])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_terms", "terms", "tf"))):
            if row[2]:
                held.append(row)
                n_held += len(row[2]) // 4
            if len(held) == held_documents or n_held >= held_terms:
                yield from grown()
                held, n_held = [], 0
    if held:
        yield from grown()


FOUND = "item long, doc_id long, score long"


def _search(items: list[Item], place: np.ndarray, n_documents: int, all_terms: int, k: int, tree_documents: int):
    out = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        best: list[list] = [[] for _ in items]
        weight_of = np.zeros(len(place), np.int64)
        for tree in trees_of(batches, place, n_documents, all_terms, tree_documents):
            for i, item in enumerate(items):
                weight_of[item.terms] = item.weights
                tree.search(item, weight_of, best[i], k)
                weight_of[item.terms] = 0
        rows = [(i, None if -d == NO_ID else -d, s) for i, heap in enumerate(best) for s, d in heap]
        if rows:
            item, doc, score = zip(*rows)
            yield table_of(out, item=item, doc_id=doc, score=score)

    return run


def _best(found: DataFrame, k: int, *salt: str) -> DataFrame:
    order = Window.partitionBy("item_id", *salt).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = 1 << 18, tree_documents: int = 2048
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each item of ``items`` (item_id, text) the ``k`` rows of ``docs`` (doc_id, text)
    with the highest scores above 0, equal scores by ascending doc_id, null ids last.

    Items of one id, a null id included, are one item with the terms of all of them. Each row of ``docs`` is a document,
    so a repeated one may be found twice. Null and empty texts have no terms: such documents don't count and are
    never found, such items find nothing. Other columns take no part. Items come in blocks of about ``block_terms`` different
    terms, by a hash of their id; an item is not divided. One block's terms and weights are on the
    driver and in each task at a time. Texts are read about 1 MB at a time, besides the text itself.
    """
    spark = docs.sparkSession
    asked = settle(
        items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text"))
        .mapInArrow(_item_terms, "item_id long, term string, times long")
        .groupBy("item_id", "term").agg(F.sum("times").alias("times")),
        "search-terms",
    )
    blocks = max(1, math.ceil(asked.count() / block_terms))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    results = [_search_block(texts, asked.where(F.col("block") == b), k, tree_documents) for b in range(blocks)]
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    nearly = _best(found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(256))), k, "salt").drop("salt", "rank")
    return _best(nearly, k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_block(texts: DataFrame, asked: DataFrame, k: int, tree_documents: int) -> DataFrame:
    """The best of each task, ``(item_id, doc_id, score)``, for the items of one block."""
    spark = texts.sparkSession
    rows = asked.select("item_id", "term", "times").collect()
    terms = sorted({r.term for r in rows})
    if not terms:
        return spark.createDataFrame([], "item_id long, doc_id long, score long")
    number = {t: i for i, t in enumerate(terms)}
    vectors = settle(texts.mapInArrow(_restricted({t.encode(): i for t, i in number.items()}), VECTORS), "search-vectors")
    counted = vectors.where("n_terms > 0").agg(F.count("*").alias("n"), F.sum("n_terms").alias("all")).first()
    df = np.zeros(len(terms), np.int64)
    for r in vectors.select("terms").mapInArrow(_document_frequencies(len(terms)), "number long, df long").groupBy("number").agg(F.sum("df").alias("df")).collect():
        df[r.number] = r.df
    order = np.argsort(-df, kind="stable")  # the most frequent first
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    of_item: dict[int | None, list] = {}
    for r in rows:
        of_item.setdefault(r.item_id, []).append((int(place[number[r.term]]), term_weight(counted.n, int(df[number[r.term]])) * r.times))
    ids = list(of_item)
    ready = []
    for pairs in of_item.values():
        at, weights = zip(*sorted(pairs))
        ready.append(Item(np.asarray(at, np.int64), np.asarray(weights, np.int64)))
    search = _search(ready, place, counted.n, counted.all or 0, k, tree_documents)
    found = settle(vectors.mapInArrow(search, FOUND), "search-found")
    names = spark.createDataFrame(
        pa.table({"item": pa.array(range(len(ids)), pa.int64()), "item_id": pa.array(ids, pa.int64())}), "item long, item_id long"
    )
    return found.join(names, "item").select("item_id", "doc_id", "score")
