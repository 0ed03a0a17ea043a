"""Token ids in files: frequency-ranked ids, byte-aligned variable-length coding, separate control bytes.

A table of blocks in Parquet is the file format: each row is one block of whole documents,
rows follow each other in ascending doc_id order inside a shard and shards ascend too.
An id is replaced by its rank in the corpus (0: the most frequent), a rank takes one to
four little-endian bytes, and the byte lengths of four ranks share one control byte that
stands apart from the data, so decoding is a table lookup on whole arrays.
A second small table, the code book, holds the id of each rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgauge.llm.common import in_pieces, kept_in_worker, table_of, text_bytes
from driftgauge.llm.tokens import PieceMemory, values_of
from driftgauge.session import settle

END_ID = 1
#: In place of a number of tokens: the row holds how often its task has met each id.
COUNTS = -1
#: Byte lengths of the four ranks behind each control byte; the first rank has the low bits.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-len(code) % 4 + len(code), np.uint8)
    padded[: len(code)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def _id_memory(path: str) -> PieceMemory:
    return kept_in_worker(
        ("token ids", path), lambda: PieceMemory(path, lambda ids: ids.tobytes(), b"".join, tail="</w>", limit=400_000)
    )


def _tokenize(path: str, end_id: int):
    """White space never enters a token of this kind of tokenizer and ASCII case is folded, so the pieces are
    the lower-cased words between ASCII white space."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        memory = _id_memory(path)
        end, codec = np.asarray([end_id], "<u4").tobytes(), pa.Codec("zstd", 1)
        total = np.zeros(1, np.int64)
        for batch in in_pieces(batches, "text", 1 << 20):
            texts = [_folded(t).split() for t in batch.column("text").to_pylist()]
            ids = [b"".join(v) + end for v in values_of(memory, texts)]
            found = np.bincount(np.frombuffer(b"".join(ids), "<u4"), minlength=len(total))
            found[: len(total)] += total
            total = found
            yield table_of(
                out, doc_id=batch.column("doc_id"), n_tokens=[len(i) // 4 for i in ids],
                ids=[codec.compress(i, asbytes=True) for i in ids],
            )
        yield table_of(out, doc_id=[None], n_tokens=[COUNTS], ids=[total.astype("<i8").tobytes()])

    return run


def _folded(text: bytes) -> bytes:
    return text if b"<|" in text else text.lower()  # special strings are matched before folding


def _ids(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd"), "<u4")


def _added(batches):
    """The sum of tasks' counts of ids, for those that occur."""
    out = pa.schema([("id", pa.int64()), ("n", pa.int64())])
    total = np.zeros(1, np.int64)
    for batch in batches:
        for blob in batch.column("ids").to_pylist():
            found = np.frombuffer(blob, "<i8")
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[: len(found)] += found
    present = np.flatnonzero(total)
    yield table_of(out, id=present, n=total[present])


BLOCKS = (
    "shard int, block int, start long, n_ids long, doc_ids binary, doc_nulls binary, doc_lengths binary, "
    "control binary, data binary"
)


def _write_blocks(ids_by_rank: np.ndarray, block_ids: int):
    rank_of = np.zeros(int(ids_by_rank.max(initial=0)) + 1, "<u4")
    rank_of[ids_by_rank] = np.arange(len(ids_by_rank), dtype="<u4")
    out = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64())]
        + [(c, pa.binary()) for c in ("doc_ids", "doc_nulls", "doc_lengths", "control", "data")]
    )

    def run(batches):
        from pyspark import TaskContext

        shard, block, start = TaskContext.get().partitionId(), 0, 0
        docs, lengths, parts, held = [], [], [], 0

        def flush():
            nonlocal block, start, docs, lengths, parts, held
            control, data = pack(rank_of[np.concatenate(parts)])
            row = table_of(
                out, shard=[shard], block=[block], start=[start], n_ids=[held], control=[control], data=[data],
                doc_ids=[np.asarray([d or 0 for d in docs], "<i8").tobytes()],
                doc_nulls=[np.packbits([d is None for d in docs]).tobytes()],
                doc_lengths=[np.asarray(lengths, "<i8").tobytes()],
            )
            block, start = block + 1, start + held
            docs, lengths, parts, held = [], [], [], 0
            return row

        for batch in batches:
            for d, n, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids"))):
                if held and held + n > block_ids:
                    yield flush()
                docs.append(d)
                lengths.append(n)
                parts.append(_ids(blob, n))
                held += n
        if held:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, block_ids: int = 1 << 18
) -> None:
    """Encodes the texts of ``docs`` (doc_id, text), ends each with ``end_id`` and writes ``path``/blocks and
    ``path``/codebook in ascending doc_id order (null last; ties in the order of their ids' bytes).

    Null texts are empty: only the end id. A document is never split between blocks, and a block holds
    ``block_ids`` ids at most unless one document has more. Only the code book, as long as the vocabulary,
    reaches the driver.
    """
    spark = docs.sparkSession
    encoded = settle(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(
            _tokenize(vocabulary, end_id), "doc_id long, n_tokens long, ids binary"
        ),
        "token-ids",
    )
    counts = encoded.where(F.col("n_tokens") == COUNTS).select("ids").mapInArrow(_added, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    book = [r.id for r in sorted(counts.collect(), key=lambda r: (-r.n, r.id))]
    spark.createDataFrame(
        pa.table({"rank": pa.array(range(len(book)), pa.int64()), "id": pa.array(book, pa.int64())}),
        "rank long, id long",
    ).coalesce(1).write.parquet(f"{path}/codebook")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.where(F.col("n_tokens") != COUNTS).repartitionByRange(parts, F.col("doc_id").asc_nulls_last()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_last(), "n_tokens", "ids"
    )
    blocks = ordered.mapInArrow(_write_blocks(np.asarray(book, np.int64), block_ids), BLOCKS)
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")


DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read_blocks(ids_by_rank: np.ndarray, with_ids: bool):
    fields = [(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
    out = pa.schema(fields + [("ids", pa.binary())] * with_ids)
    table = ids_by_rank.astype("<u4")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = table[unpack(row["control"], row["data"], row["n_ids"])]
                docs, lengths = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_lengths"], "<i8")
                nulls = np.unpackbits(np.frombuffer(row["doc_nulls"], np.uint8))[: len(docs)].astype(bool)
                ends = np.cumsum(lengths)
                pieces = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths)]
                yield table_of(
                    out, doc_id=pa.array(docs, mask=nulls), start=ends - lengths + row["start"] + row["before"],
                    n_tokens=lengths, ids_crc32=[zlib.crc32(p) for p in pieces], ids=pieces,
                )

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` decoded from the files; ``ids`` little-endian 32-bit."""
    book = [r.id for r in sorted(spark.read.parquet(f"{path}/codebook").collect())]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # one row for each file of the table, so its size is that of the file list
    placed = blocks.join(F.broadcast(offsets), "shard")
    return placed.mapInArrow(
        _read_blocks(np.asarray(book, np.int64), with_ids), DECODED + ", ids binary" * with_ids
    )
