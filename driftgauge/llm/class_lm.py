"""Class-based bigram model: exchange clustering assigns words to classes, classes predict each other.

    P(text) = product over tokens of P(class | class before) * P(word | class)

Words are counted over all training texts. The most frequent ``head`` words get numbers that
tasks can hold; all others start in a class given by their length, so their place in the chain
is known without a look-up, and their counts and classes are joined to the texts in Spark. The
``exchanged`` most frequent words are clustered first: each round counts, over the whole corpus,
how often each class stands before and after each of them, and moves half of the words to
the class that raises the likelihood of the class bigrams most. Then every other word seen more
than once moves in the same way, numbered or not: once, against the classes of the rounds.
Words seen once, of which nothing is left if one leaves their only place out, stay in the
class of their length; they are all that tells of words never seen.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import in_pieces, table_of, text_bytes
from driftgauge.session import settle

#: Classes of words not seen or seen once: by their length in bytes, four lengths to a class.
SHAPES = 8
SLICE = 1024
#: Neighbours that a task counts together, and words without a number whose neighbours it holds.
NEIGHBOURS, WORDS_TOGETHER = 1 << 22, 4096
#: Numbers of clusters of words without a number, below those of the shapes, in the texts.
PLACED = -1 - SHAPES
#: Added to the count of each word of a class, and weight of the class's own frequency among its successors.
EMISSION, TRANSITION = 0.5, 5.0


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words stand between ASCII white space."""
    return text.lower().split()


def _count_words(limit: int):
    out = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            items = list(counts.items())
            counts.clear()
            for a in range(0, len(items), 50_000):
                words, n = zip(*items[a : a + 50_000])
                yield table_of(out, word=[w.decode() for w in words], n=n)

        for batch in in_pieces(batches, "text", 2 << 20):
            for text in batch.column("text").to_pylist():
                counts.update(words_of(text))
            if len(counts) > limit:
                yield from flush()
        yield from flush()

    return run


@dataclass
class Vocabulary:
    """Head words in order of frequency, and totals over all training tokens (the ends counted too)."""

    blob: bytes
    counts: np.ndarray
    least: int
    ends: int
    tokens: int
    types: int
    shape_tokens: np.ndarray
    shape_types: np.ndarray

    def numbers(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.blob.split(b"\n"))} if len(self.counts) else {}


def shape_of(word: Column) -> Column:
    return F.least(F.floor(F.octet_length(word) / 4), F.lit(SHAPES - 1)).cast("int")


def count_words(docs: DataFrame, train: Column) -> DataFrame:
    """``(word, n)`` over the texts of ``docs`` that satisfy ``train``."""
    return docs.where(train).select(text_bytes().alias("text")).mapInArrow(
        _count_words(200_000), "word string, n long"
    ).groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(words: DataFrame, ends: int, head: int) -> Vocabulary:
    """At most ``head`` of the most frequent words reach the driver: all above a count that a histogram gives."""
    level = F.floor(F.log2("n") * 16).cast("int")
    histogram = words.groupBy(level.alias("level")).agg(
        F.count("*").alias("types"), F.sum("n").alias("tokens"), F.min("n").alias("least")
    ).collect()
    shapes = words.groupBy(shape_of(F.col("word")).alias("shape")).agg(
        F.count("*").alias("types"), F.sum("n").alias("tokens")
    ).collect()
    least, held = 1 << 62, 0
    for r in sorted(histogram, key=lambda r: -r.level):
        if held + r.types > head:
            break
        held, least = held + r.types, r.least
    top = sorted(((w, n) for w, n in words.where(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0])) if held else []
    tokens, types = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for r in shapes:
        tokens[r["shape"]], types[r["shape"]] = r["tokens"], r["types"]
    return Vocabulary(
        b"\n".join(w.encode() for w, _ in top), np.asarray([n for _, n in top], np.int64), least, ends,
        sum(r["tokens"] for r in histogram) + ends, sum(r["types"] for r in histogram) + (ends > 0), tokens, types,
    )


NUMBERED = "row long, doc_id long, held_out boolean, n_tokens long, ids binary, tail string"


def _number_words(voc: Vocabulary):
    out = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("tail", pa.string())]
    )

    def run(batches):
        get, codec = voc.numbers().get, pa.Codec("zstd", 1)
        for batch in in_pieces(batches, "text", 2 << 20):
            n, ids, tails = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                tail = [words[i] for i in np.flatnonzero(found < 0).tolist()]
                found[found < 0] = [-1 - min(len(w) // 4, SHAPES - 1) for w in tail]
                n.append(len(words))
                ids.append(codec.compress(found.tobytes(), asbytes=True))
                tails.append(b" ".join(tail).decode())
            yield table_of(
                out, row=batch.column("row"), doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), n_tokens=n,
                ids=ids, tail=tails,
            )

    return run


def _opened(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd"), np.int32) if n else np.zeros(0, np.int32)


def _classes(ids: np.ndarray, class_of: np.ndarray, classes: int) -> np.ndarray:
    """Classes of the tokens; a word without a number has one by its shape, or the one it was placed in."""
    return np.where(ids >= 0, class_of[np.maximum(ids, 0)], np.where(ids > PLACED, classes - 1 - ids, PLACED - ids))


_SUMS = pa.schema([("slice", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])
SUMS = "slice int, salt int, counts binary"


def _packed(counts: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(counts.tobytes(), asbytes=True)


def _unpacked(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 8 * size, codec="zstd"), np.int64)


def _count_neighbours(class_of: np.ndarray, classes: int, exchanged: int, salts: int):
    """Counts of (word, class before), (word, class after) for clustered words by slices, and of class pairs."""
    k = classes + SHAPES + 1
    end = k - 1

    def run(batches):
        from pyspark import TaskContext

        before, after = np.zeros(exchanged * k, np.int64), np.zeros(exchanged * k, np.int64)
        pairs = np.zeros(k * k, np.int64)
        for batch in batches:
            parts, cs = [], []
            for blob, n in zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist()):
                ids = _opened(blob, n)
                parts += [ids, np.full(1, -1, np.int32)]
                cs += [_classes(ids, class_of, classes), np.full(1, end)]
            if not parts:
                continue
            words, c = np.concatenate(parts), np.concatenate(cs).astype(np.int64)
            previous = np.concatenate([[end], c[:-1]])
            following = np.concatenate([c[1:], [end]])
            pairs += np.bincount(previous * k + c, minlength=k * k)
            at = np.flatnonzero((words >= 0) & (words < exchanged))
            w = words[at].astype(np.int64) * k
            before += np.bincount(w + previous[at], minlength=exchanged * k)
            after += np.bincount(w + following[at], minlength=exchanged * k)
        salt = TaskContext.get().partitionId() % salts
        yield table_of(_SUMS, slice=[-1], salt=[salt], counts=[_packed(pairs)])
        for s, a in enumerate(range(0, exchanged, SLICE)):
            b = min(exchanged, a + SLICE)
            part = np.concatenate([before[a * k : b * k], after[a * k : b * k]])
            if part.any():
                yield table_of(_SUMS, slice=[s], salt=[salt], counts=[_packed(part)])

    return run


def _sum_slices(k: int, exchanged: int):
    """Sums of the slices in this partition, one held for each of them."""

    def size_of(s: int) -> int:
        return k * k if s < 0 else 2 * k * (min(exchanged, (s + 1) * SLICE) - s * SLICE)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                part = _unpacked(blob, size_of(s))
                sums[s] = sums[s] + part if s in sums else part
        for s, total in sums.items():
            yield table_of(_SUMS, slice=[s], salt=[0], counts=[_packed(total)])

    return run


def neighbour_counts(numbered: DataFrame, class_of: np.ndarray, classes: int, exchanged: int, salts: int) -> DataFrame:
    """``(slice, salt, counts)``, one row for each slice; slice -1 holds the class pairs. Summed in two steps,
    so no task meets more than a root of all tasks' parts."""
    k = classes + SHAPES + 1
    counted = numbered.select("n_tokens", "ids").mapInArrow(_count_neighbours(class_of, classes, exchanged, salts), SUMS)
    add = _sum_slices(k, exchanged)
    return counted.repartition("slice", "salt").mapInArrow(add, SUMS).repartition("slice").mapInArrow(add, SUMS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def better_classes(before: np.ndarray, after: np.ndarray, pairs: np.ndarray, mine: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word that raises the likelihood of the class bigrams most, all other words staying."""
    total = before.sum(1)
    out = np.empty(len(mine), np.int64)
    for i in range(len(mine)):
        a, l, r, n = mine[i], before[i], after[i], total[i]
        p = pairs.copy()
        p[a] -= r
        p[:, a] -= l
        np.maximum(p, 0, out=p)
        size = p.sum(1)
        rows, columns = p[:classes], p[:, :classes]
        some_r, some_l = np.flatnonzero(r), np.flatnonzero(l)
        gain = (_xlogx(rows[:, some_r] + r[some_r]) - _xlogx(rows[:, some_r])).sum(1)
        gain += (_xlogx(columns[some_l] + l[some_l, None]) - _xlogx(columns[some_l])).sum(0)
        gain -= 2 * (_xlogx(size[:classes] + n) - _xlogx(size[:classes]))
        best = int(np.argmax(gain))
        out[i] = best if gain[best] > gain[a] + 1e-9 else a
    return out


def _exchange(pairs: np.ndarray, class_of: np.ndarray, classes: int, exchanged: int, turn: int):
    k = classes + SHAPES + 1
    out = pa.schema([("word", pa.int32()), ("class", pa.int32())])

    def run(batches):
        for batch in batches:
            for s, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                a, b = s * SLICE, min(exchanged, (s + 1) * SLICE)
                before, after = _unpacked(blob, 2 * k * (b - a)).reshape(2, b - a, k)
                words = np.arange(a, b)
                moving = words % 2 == turn % 2
                found = better_classes(before[moving], after[moving], pairs, class_of[words[moving]], classes)
                yield table_of(out, **{"word": words[moving], "class": found})

    return run


def _count_rest(class_of: np.ndarray, classes: int, first: int, last: int):
    """Counts of (word, class before or after) for the words numbered from ``first`` to ``last``, by slices, those that occur."""
    k = classes + SHAPES + 1
    out = pa.schema([("slice", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("size", pa.int32())])
    slices = np.arange(first // SLICE, -(-last // SLICE))

    def run(batches):
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(keys, np.append(slices, slices[-1] + 1) * (SLICE * 2 * k))
            for s, a, b in zip(slices.tolist(), cuts.tolist(), cuts[1:].tolist()):
                if a < b:
                    steps = np.diff(keys[a:b], prepend=s * SLICE * 2 * k)
                    yield table_of(out, slice=[s], keys=[_packed(steps)], counts=[_packed(n[a:b])], size=[b - a])
            held.clear()

        for batch in batches:
            for blob, n in zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist()):
                ids = _opened(blob, n)
                at = np.flatnonzero((ids >= first) & (ids < last))
                if not len(at):
                    continue
                c = np.concatenate([[k - 1], _classes(ids, class_of, classes), [k - 1]])
                words = ids[at].astype(np.int64) * (2 * k)
                held += [words + c[at], words + k + c[at + 2]]
                size += 2 * len(at)
                if size > NEIGHBOURS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


REST = "slice int, keys binary, counts binary, size int"


def best_classes(word: np.ndarray, column: np.ndarray, n: np.ndarray, mine: np.ndarray, pairs: np.ndarray, classes: int) -> np.ndarray:
    """The class each word of a shape joins: the one that raises the likelihood of the class bigrams most.

    ``n`` is how often class ``column`` stands before a word, or class ``column - len(pairs)`` after it; ``word`` ascends
    and ``mine`` has the shape class of each word.
    """
    k, words = len(pairs), len(mine)
    joint = np.concatenate([pairs[:, :classes], pairs[:classes].T])
    same, which = np.unique(column * (n.max(initial=0) + 1) + n, return_inverse=True)
    base, more = joint[same // (n.max(initial=0) + 1)], (same % (n.max(initial=0) + 1))[:, None]
    gain = (_xlogx(base + more) - _xlogx(base))[which]
    # a word that leaves its class takes along the bigrams it makes there
    own = np.flatnonzero(column % k == mine[word])
    dense = np.zeros((words, 2 * k), np.int64)
    dense[word, column] = n
    if len(own):
        other = np.where((column[own] < k)[:, None], dense[word[own], k : k + classes], dense[word[own], :classes])
        base = np.maximum(joint[column[own]] - other, 0)
        gain[own] = _xlogx(base + n[own][:, None]) - _xlogx(base)
    total = np.bincount(word, n, words)[:, None] / 2
    size = pairs[:classes].sum(1)
    sums = np.add.reduceat(gain, np.searchsorted(word, np.arange(words)))
    # bigrams inside the class it joins grow from both sides
    inside, before, after = np.diag(pairs)[:classes], dense[:, :classes], dense[:, k : k + classes]
    sums += _xlogx(inside + before + after) - _xlogx(inside + before) - _xlogx(inside + after) + _xlogx(inside)
    return np.argmax(sums - 2 * (_xlogx(size + total) - _xlogx(size)), axis=1)


def _move_rest(pairs: np.ndarray, class_of: np.ndarray, classes: int):
    k = len(pairs)
    out = pa.schema([("word", pa.int32()), ("class", pa.int32())])

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, keys, counts, size in zip(*(batch.column(c).to_pylist() for c in ("slice", "keys", "counts", "size"))):
                if s not in sums:
                    sums[s] = np.zeros(SLICE * 2 * k, np.int64)
                sums[s][np.cumsum(_unpacked(keys, size))] += _unpacked(counts, size)
        for s, total in sums.items():
            at = np.flatnonzero(total)
            words, word = np.unique(at // (2 * k), return_inverse=True)
            found = best_classes(word, at % (2 * k), total[at], class_of[s * SLICE + words], pairs, classes)
            yield table_of(out, **{"word": s * SLICE + words, "class": found})

    return run


def _tail_neighbours(class_of: np.ndarray, classes: int):
    """``(word, pair)`` of each word without a number: the classes before and after it."""
    k = classes + SHAPES + 1
    out = pa.schema([("word", pa.string()), ("pair", pa.int32())])

    def run(batches):
        for batch in batches:
            for blob, n, tail in zip(*(batch.column(c).to_pylist() for c in ("ids", "n_tokens", "tail"))):
                if tail:
                    ids = _opened(blob, n)
                    c = np.concatenate([[k - 1], _classes(ids, class_of, classes), [k - 1]])
                    at = np.flatnonzero(ids < 0)
                    words, pair = tail.split(" "), c[at] * k + c[at + 2]
                    for a in range(0, len(words), 100_000):
                        yield table_of(out, word=words[a : a + 100_000], pair=pair[a : a + 100_000])

    return run


def _move_tail(pairs: np.ndarray, classes: int):
    k = len(pairs)
    out = pa.schema([("word", pa.string()), ("class", pa.int32())])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, WORDS_TOGETHER):
                part = batch.slice(a, WORDS_TOGETHER)
                words, found = part.column("word"), part.column("found")
                each = np.repeat(np.arange(len(words)), np.diff(found.offsets.to_numpy()))
                pair, n = (found.flatten().field(f).to_numpy() for f in ("pair", "n"))
                keys = np.concatenate([each * (2 * k) + pair // k, each * (2 * k) + k + pair % k])
                at, line = np.unique(keys, return_inverse=True)
                total = np.bincount(line, np.concatenate([n, n]), len(at)).astype(np.int64)
                mine = classes + part.column("shape").to_numpy()
                yield table_of(out, **{"word": words, "class": best_classes(at // (2 * k), at % (2 * k), total, mine, pairs, classes)})

    return run


def exchange_rest(
    train: DataFrame, words: DataFrame, voc: Vocabulary, class_of: np.ndarray, classes: int, exchanged: int
) -> tuple[np.ndarray, DataFrame]:
    """Moves each word seen more than once that the rounds did not: ``class_of`` the head words, and
    ``(word, n, class)`` of all words without a number."""
    begun, pairs = class_of, class_pairs(train, class_of, classes)
    first, last = min(exchanged, len(voc.counts)), int(np.count_nonzero(voc.counts > 1))
    if first < last:
        counted = train.select("n_tokens", "ids").mapInArrow(_count_rest(begun, classes, first, last), REST)
        moved = counted.repartition("slice").mapInArrow(_move_rest(pairs, begun, classes), "word int, class int").collect()
        class_of = class_of.copy()
        for word, c in moved:  # as many rows as words with a number
            class_of[word] = c
    rare = words.where(F.col("n") < voc.least).withColumn("class", shape_of(F.col("word")) + classes)
    if voc.least > 2:
        found = train.where("tail <> ''").select("n_tokens", "ids", "tail").mapInArrow(
            _tail_neighbours(begun, classes), "word string, pair int"
        ).repartition("word").groupBy("word", "pair").agg(F.count(F.lit(1)).alias("n"))
        found = found.groupBy("word").agg(F.collect_list(F.struct("pair", "n")).alias("found"), F.sum("n").alias("seen"))
        moved = found.where("seen > 1").select("word", shape_of(F.col("word")).alias("shape"), "found").mapInArrow(
            _move_tail(pairs, classes), "word string, class int"
        )
        rare = rare.join(moved.withColumnRenamed("class", "_moved"), "word", "left").select(
            "word", "n", F.coalesce("_moved", "class").alias("class")
        )
    return class_of, settle(rare, "rare-words")


def _shapes(voc: Vocabulary) -> np.ndarray:
    lengths = np.fromiter(map(len, voc.blob.split(b"\n")), np.int64, max(len(voc.counts), 1))[: len(voc.counts)]
    return np.minimum(lengths // 4, SHAPES - 1)


def class_pairs(train: DataFrame, class_of: np.ndarray, classes: int) -> np.ndarray:
    """How often each class follows each class in the texts."""
    k = classes + SHAPES + 1
    salts = max(1, math.isqrt(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = neighbour_counts(train, class_of, classes, 0, salts).where("slice = -1").collect()
    return sum((_unpacked(bytes(r.counts), k * k) for r in found), np.zeros(k * k, np.int64)).reshape(k, k)


def exchange(train: DataFrame, voc: Vocabulary, classes: int, exchanged: int, rounds: int) -> np.ndarray:
    """The classes of the head words after ``rounds`` that move the ``exchanged`` most frequent ones."""
    k, head = classes + SHAPES + 1, len(voc.counts)
    exchanged = min(exchanged, head)
    class_of = np.concatenate([np.arange(exchanged) % classes, classes + _shapes(voc)[exchanged:], [0]])  # never empty
    salts = max(1, math.isqrt(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for turn in range(rounds if exchanged else 0):
        sums = settle(neighbour_counts(train, class_of, classes, exchanged, salts), "neighbour-counts")
        found = sums.where("slice = -1").collect()
        pairs = sum((_unpacked(bytes(r.counts), k * k) for r in found), np.zeros(k * k, np.int64)).reshape(k, k)
        moved = sums.where("slice >= 0").repartition("slice").mapInArrow(
            _exchange(pairs, class_of, classes, exchanged, turn), "word int, class int"
        ).collect()  # as many rows as clustered words
        class_of = class_of.copy()
        for word, c in moved:
            class_of[word] = c
    return class_of


@dataclass
class Emissions:
    """log10 of each head word within its class; ``base``: the log10 denominator of a word's probability in each class."""

    head: np.ndarray
    base: np.ndarray


def emissions(voc: Vocabulary, class_of: np.ndarray, classes: int, rare: DataFrame | None = None) -> Emissions:
    """``rare``: the words without a number, with their classes; without it they are in the class of their shape."""
    k, counts, member = classes + SHAPES + 1, voc.counts, class_of[: len(voc.counts)]
    tokens = np.bincount(member, counts, minlength=k).astype(float)
    types = np.bincount(member, minlength=k).astype(float)
    clustered, shapes = member < classes, _shapes(voc)
    # words of a shape: all but the clustered ones, and one type for what was never seen
    tokens[classes : classes + SHAPES] = voc.shape_tokens - np.bincount(shapes[clustered], counts[clustered], minlength=SHAPES)
    types[classes : classes + SHAPES] = voc.shape_types - np.bincount(shapes[clustered], minlength=SHAPES) + 1
    if rare is not None:
        moved = rare.where(F.col("class") < classes).groupBy("class", shape_of(F.col("word")).alias("shape"))
        for r in moved.agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens")).collect():
            for place, sign in ((r["class"], 1), (classes + r["shape"], -1)):
                tokens[place] += sign * r["tokens"]
                types[place] += sign * r["types"]
    base = np.log10(np.maximum(tokens + EMISSION * types, 1e-300))
    return Emissions(np.append(np.log10(counts + EMISSION) - base[member], 0.0), base)


@dataclass
class ClassModel:
    """``class_of`` the head words, log10 of the class transitions and of each head word within its class;
    ``shape_base``: for the words of a shape, the log10 denominator of their probability within it."""

    class_of: np.ndarray
    classes: int
    transition: np.ndarray
    emission: np.ndarray
    shape_base: np.ndarray


def fitted(train: DataFrame, class_of: np.ndarray, classes: int, emitted: Emissions) -> ClassModel:
    pairs = class_pairs(train, class_of, classes)
    size = pairs.sum(0)
    own = (size + 1) / (size.sum() + len(pairs))
    transition = np.log10((pairs + TRANSITION * own) / (pairs.sum(1, keepdims=True) + TRANSITION))
    return ClassModel(class_of, classes, transition, emitted.head, emitted.base[classes : classes + SHAPES])


def cluster(numbered: DataFrame, voc: Vocabulary, classes: int, exchanged: int, rounds: int) -> ClassModel:
    """The model after the rounds alone."""
    train = numbered.where("not held_out")
    class_of = exchange(train, voc, classes, exchanged, rounds)
    return fitted(train, class_of, classes, emissions(voc, class_of, classes))


def _place_tails(classes: int):
    """Writes the clusters of the words without a number into the texts; ``places`` are in the order of the words."""
    out = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
        + [("t_known", pa.int64()), ("t_base", pa.float64()), ("t_score", pa.float64())]
    )

    def run(batches):
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            blobs = []
            for i, (blob, n) in enumerate(zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist())):
                places = batch.column("places")[i].values
                if places is not None and len(places):
                    c = places.to_numpy(zero_copy_only=False) % (classes + SHAPES)
                    ids = _opened(blob, n).copy()
                    ids[ids < 0] = np.where(c < classes, PLACED - c, classes - 1 - c)
                    blob = codec.compress(ids.tobytes(), asbytes=True)
                blobs.append(blob)
            yield table_of(out, **{f.name: blobs if f.name == "ids" else batch.column(f.name) for f in out})

    return run


def place_tails(numbered: DataFrame, rare: DataFrame, voc: Vocabulary, classes: int, emitted: Emissions) -> DataFrame:
    """``numbered`` with the classes of its words without a number, and with the sums of their counts and scores."""
    tails = numbered.where("tail <> ''").select("row", F.posexplode(F.split("tail", " ")).alias("pos", "word"))
    n, width = F.coalesce("n", F.lit(0)), classes + SHAPES
    place = F.coalesce("class", shape_of(F.col("word")) + classes)
    base = F.get(F.array(*[F.lit(float(x)) for x in emitted.base]), place)
    tail = tails.join(rare, "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, 1).otherwise(0)).alias("t_known"),
        F.sum(F.log10(n + 1.0) - math.log10(voc.tokens + voc.types + 1)).alias("t_base"),
        F.sum(F.log10(n + EMISSION) - base).alias("t_score"),
        F.sort_array(F.collect_list(F.col("pos").cast("long") * width + place)).alias("places"),
    )
    return settle(
        numbered.drop("tail").join(tail, "row", "left").mapInArrow(_place_tails(classes), PLACED_ROWS), "placed-words"
    )


PLACED_ROWS = (
    "row long, doc_id long, held_out boolean, n_tokens long, ids binary, t_known long, t_base double, t_score double"
)


HEADS = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
    "t_known long, t_base double, t_score double"
)


def _score_heads(model: ClassModel, voc: Vocabulary):
    k = model.classes + SHAPES + 1
    out = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64())]
        + [("base_score", pa.float64()), ("score", pa.float64()), ("t_known", pa.int64()), ("t_base", pa.float64()), ("t_score", pa.float64())]
    )
    floor = math.log10(voc.tokens + voc.types + 1)
    base = np.append(np.log10(voc.counts + 1.0), 0.0)
    end = math.log10(voc.ends + 1) - floor

    def run(batches):
        for batch in batches:
            known, bases, scores = [], [], []
            for blob, n in zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist()):
                ids = _opened(blob, n)
                c = np.concatenate([[k - 1], _classes(ids, model.class_of, model.classes), [k - 1]])
                head = ids[ids >= 0]
                known.append(len(head) + (voc.ends > 0))
                bases.append(float(base[head].sum()) - len(head) * floor + end)
                scores.append(float(model.transition[c[:-1], c[1:]].sum() + model.emission[head].sum()))
            yield table_of(
                out, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"),
                n_tokens=[n + 1 for n in batch.column("n_tokens").to_pylist()], n_known=known, base_score=bases, score=scores,
                **{c: batch.column(c) for c in ("t_known", "t_base", "t_score")},
            )

    return run


def score_documents(
    docs: DataFrame, held_out: Column, head: int = 1 << 18, exchanged: int = 1 << 13, classes: int = 48, rounds: int = 4
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    The model is learned from the rows that are not ``held_out``. ``score`` is the log10 probability of the text
    with its end; ``base_score`` that of a unigram model with one added to each count. Null texts are empty: one
    token, the end. Repeated rows count each time; an empty table gives an empty result, and without training
    rows all words are unknown.
    """
    spark = docs.sparkSession
    marked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out")
    )
    words = settle(count_words(marked, ~F.col("held_out")), "word-counts")
    ends = marked.where(~F.col("held_out")).count()
    voc = vocabulary(words, ends, head)
    numbered = settle(
        marked.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", text_bytes().alias("text")
        ).mapInArrow(_number_words(voc), NUMBERED),
        "numbered-words",
    )
    train = numbered.where("not held_out")
    class_of = exchange(train, voc, classes, exchanged, rounds)
    class_of, rare = exchange_rest(train, words, voc, class_of, classes, exchanged)
    emitted = emissions(voc, class_of, classes, rare)
    placed = place_tails(numbered, rare, voc, classes, emitted)
    model = fitted(placed.where("not held_out"), class_of, classes, emitted)
    zero = F.lit(0.0)
    return placed.mapInArrow(_score_heads(model, voc), HEADS).select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("t_known", F.lit(0))).alias("n_known"),
        F.lit(voc.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("t_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("t_score", zero)).alias("score"),
    )
