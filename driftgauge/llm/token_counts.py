"""Token counts by overlap resynchronisation.

Texts up to ``chunk`` characters are encoded as they are. Longer ones are cut into chunks
that overlap; each chunk is encoded with offsets on its own, wherever Spark puts it, and
the encodings are spliced at a boundary that both must have. Such a boundary is the start
of ASCII white space behind a character that no engine takes for white space: no
alternative of the pre-tokenizer pattern holds a non-space followed by a space, and the
pattern is matched left to right without memory, so from there on both encodings agree.
The overlap is doubled until it holds enough such places, and where the encodings of the
overlap differ all the same, the document is cut anew with a wider overlap, up to the whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import in_pieces, kept_in_worker, table_of, text_bytes
from driftgauge.llm.tokens import ODD_SPACE, SPACED_WORD, PieceMemory, values_of
from driftgauge.session import settle

STABLE = re.compile("(?<=[^\\s\\x1c-\\x1f\\u180e\\u200b-\\u200f\\ufeff])(?=[ \\t\\n\\r])")
COUNTED = "doc_id long, n_bytes long, n_tokens long"


def _count_memory(path: str) -> PieceMemory:
    return kept_in_worker(("token counts", path), lambda: PieceMemory(path, len, sum, lead="\u0120"))


def _count_texts(path: str):
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _count_memory(path)
        for batch in in_pieces(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            plain = [t if not ODD_SPACE.search(t) else None for t in texts]
            counts = values_of(memory, [SPACED_WORD.findall(t) for t in plain if t is not None])
            odd = iter(memory.encode([t for t, p in zip(texts, plain) if p is None]))
            each = iter(counts)
            n = [next(odd) if p is None else sum(next(each)) for p in plain]
            yield table_of(out, doc_id=batch.column("doc_id"), n_bytes=[len(t) for t in texts], n_tokens=n)

    return run


def cut(text: str, chunk: int, overlap: int, least: int = 4) -> list[tuple[int, int]]:
    """(start, end) of the chunks. Each starts just before a stable boundary and the one before it reaches
    over ``least`` of them; a stretch without boundaries stays in one chunk."""
    n, out, start = len(text), [], 0
    while True:
        found = STABLE.search(text, start + chunk) if start + chunk < n else None
        if not found:
            return [*out, (start, n)]
        following = max(start + chunk, found.start() - 16)
        width = max(overlap, 2 * (found.start() - following + 1))
        while following + width < n and sum(1 for _ in STABLE.finditer(text, following + 1, following + width)) < least:
            width *= 2
        if following + width >= n:
            return [*out, (start, n)]
        out.append((start, following + width))
        start = following


def _cut_texts(chunk: int, overlap: int):
    out = pa.schema([(c, pa.int64()) for c in ("row", "start", "until", "next")] + [("text", pa.string())])

    def run(batches):
        for batch in in_pieces(batches, "text", 4 << 20):
            for row, data in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                text = data.decode()
                places = cut(text, chunk, overlap)
                until = [0, *(e for _, e in places[:-1])]
                following = [*(s for s, _ in places[1:]), len(text)]
                for (s, e), u, f in zip(places, until, following):
                    yield table_of(out, row=[row], start=[s], until=[u], next=[f], text=[text[s:e]])

    return run


def summary(tokenizer, text: str, start: int, until: int, following: int) -> dict:
    """Of an encoded chunk: its tokens, and in both overlaps (up to ``until`` and from ``following`` on) the
    stable places with the tokens before each and a checksum of the ids from the place before."""
    e = tokenizer.encode(text, add_special_tokens=False)
    ids = np.asarray(e.ids, np.uint32)
    places = np.fromiter((m.start() for m in STABLE.finditer(text)), np.int64)
    ends = np.maximum.accumulate(np.asarray([b for _, b in e.offsets] or [0], np.int64))[: len(ids)]
    before = np.searchsorted(ends, places, side="right")
    marks = np.asarray([zlib.crc32(ids[a:b].tobytes()) for a, b in zip([0, *before[:-1]], before)], np.int64)
    places += start
    keep = (places <= until) | (places > following)
    return {
        "start": start, "end": start + len(text), "total": len(ids),
        "places": places[keep].tolist(), "before": before[keep].tolist(), "marks": marks[keep].tolist(),
    }


ENCODED = (
    "row long, start long, end long, total long, places array<long>, before array<long>, marks array<long>"
)


def _encode_chunks(path: str):
    lists = [(c, pa.list_(pa.int64())) for c in ("places", "before", "marks")]
    out = pa.schema([(c, pa.int64()) for c in ("row", "start", "end", "total")] + lists)

    def run(batches):
        tokenizer = _count_memory(path).tokenizer
        for batch in batches:
            for row, *rest in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "start", "until", "next"))):
                s = summary(tokenizer, *rest)
                yield table_of(out, row=[row], **{k: [v] for k, v in s.items()})

    return run


def splice(chunks: list[dict]) -> int | None:
    """Tokens of the whole document, or None where two encodings of an overlap don't agree."""
    total = skipped = 0
    for this, following in zip(chunks, chunks[1:]):
        right = dict(zip(following["places"], zip(following["before"], following["marks"])))
        left = list(zip(this["places"], this["before"], this["marks"]))
        common = [(p, n, m) for p, n, m in left if p in right and following["start"] < p < this["end"]]
        if not common:
            return None
        for (_, _, _), (p, _, m) in zip(common, common[1:]):  # the ids between common places are the same
            if right[p][1] != m:
                return None
        p, n, _ = common[0]
        if n < skipped:
            return None
        total += n - skipped
        skipped = right[p][0]
    return total + chunks[-1]["total"] - skipped


def _splice_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    chunks = pdf.sort_values("start").to_dict("records")
    n = splice(chunks)
    return pd.DataFrame({"row": [chunks[0]["row"]], "n_tokens": pd.array([n], dtype="Int64")})


def count_tokens(docs: DataFrame, vocabulary: str, chunk: int = 32_768, overlap: int = 256) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for each row of ``docs`` (doc_id, text).

    ``vocabulary`` is the path of a tokenizers file with a GPT-2 style pattern, the same on every machine.
    Null texts are empty and have 0 tokens; repeated rows and null ids are counted as they are.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    short = texts.where(F.coalesce(F.char_length("text"), F.lit(0)) <= chunk)
    counted = short.select("doc_id", text_bytes().alias("text")).mapInArrow(_count_texts(vocabulary), COUNTED)
    huge = settle(
        texts.where(F.char_length("text") > chunk).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", text_bytes().alias("text")
        ),
        "huge-texts",
    )
    done, pending, width = None, huge, overlap
    while not pending.isEmpty():
        chunks = pending.select("row", "text").mapInArrow(
            _cut_texts(chunk, width), "row long, start long, until long, next long, text string"
        )
        encoded = chunks.repartition(F.col("row"), F.col("start")).mapInArrow(_encode_chunks(vocabulary), ENCODED)
        spliced = settle(
            encoded.groupBy("row").applyInPandas(_splice_rows, "row long, n_tokens long"), "spliced-counts"
        )
        ok = spliced.where("n_tokens is not null")
        done = ok if done is None else done.unionByName(ok)
        pending = pending.join(spliced.where("n_tokens is null").select("row"), "row", "left_semi")
        width *= 8
    if done is None:
        return counted
    sizes = huge.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return counted.unionByName(sizes.join(done, "row").select("doc_id", "n_bytes", "n_tokens"))
