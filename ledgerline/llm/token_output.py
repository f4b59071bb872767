"""Token-ID output: static rANS files.

The file format.  Documents are dealt by ranges of doc_id to shards (one task
each).  A shard is a row of segments; a segment (about 4 million ids) is one
binary: a frequency table, shared by all blocks of the segment and counted over
all of its ids; the index of its documents; and independent interleaved blocks
of 2**19 ids with checkpoints and checksums (see rans.py).  Segments are stored
as rows (shard, segment, n_docs, n_tokens, data) of Parquet files, which any
file system that Spark writes can hold, and are committed by task, so a lost
executor repeats its own shard only.

Texts are shuffled once, by range; a task holds one segment.  Starts of documents
are sums over shards (one small row each) and segments.

Edge cases: null and empty texts are written as the end id alone; null ids come
first, equal ids are ordered by a hash of their texts; a table without rows gives
no segment; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, shared_folder
from .rans import Table, decode, encode
from .textscan import slices
from .tokens import encoder

SEGMENT, BLOCK = 1 << 22, 1 << 19
SEGMENT_SCHEMA = "shard int, segment int, n_docs long, n_tokens long, data binary"


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment: head, table, index, blocks."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    table = Table.of(symbols, counts[symbols])
    index = zlib.compress(
        np.array([x is None for x in doc_ids], np.uint8).tobytes()
        + np.array([x or 0 for x in doc_ids], "<i8").tobytes()
        + lengths.astype("<u8").tobytes()
    )
    blocks = [encode(ids[i : i + block], table) for i in range(0, len(ids), block)]
    said = table.to_bytes()
    head = np.array([len(doc_ids), len(index), len(blocks), *map(len, blocks)], "<u8")
    return head.tobytes() + said + index + b"".join(blocks)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    n, index_size, n_blocks = np.frombuffer(data, "<u8", 3).tolist()
    sizes = np.frombuffer(data, "<u8", n_blocks, 24).tolist()
    at = 24 + 8 * n_blocks
    table, used = Table.from_bytes(data[at:])
    at += used
    index = zlib.decompress(data[at : at + index_size])
    at += index_size
    missing = np.frombuffer(index, np.uint8, n)
    doc_ids = [None if m else x for m, x in zip(missing.tolist(), np.frombuffer(index, "<i8", n, n).tolist(), strict=True)]
    lengths = np.frombuffer(index, "<u8", n, 9 * n)
    ids = []
    for size in sizes:
        ids.append(decode(data[at : at + size], table))
        at += size
    return doc_ids, lengths, np.concatenate(ids) if ids else np.zeros(0, np.uint32)


def _write(path: str, end_id: int, segment: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "ids")
        shard, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        parts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            ids = np.frombuffer(b"".join(parts), "<u4").astype(np.uint32)
            lengths = np.array([len(p) // 4 for p in parts], np.int64)
            row = [[shard], [number], [len(doc_ids)], [len(ids)], [pack(doc_ids, lengths, ids)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            doc_ids.clear()
            parts.clear()
            number, size = number + 1, 0
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, types, strict=True)], names=["shard", "segment", "n_docs", "n_tokens", "data"]
            )

        for batch in batches:
            ids_of, text_of = batch.column(0), batch.column(1)
            for i, j, *_ in slices(text_of):
                texts = [t or "" for t in text_of.slice(i, j - i).to_pylist()]
                cut = [enc.pretokens(t) for t in texts]
                whole = iter(enc.whole([t for t, c in zip(texts, cut, strict=True) if c is None]))
                known = enc.pieces().__getitem__
                for doc_id, c in zip(ids_of.slice(i, j - i).to_pylist(), cut, strict=True):
                    own = np.array(next(whole), "<u4").tobytes() if c is None else b"".join(map(known, c))
                    doc_ids.append(doc_id)
                    parts.append(own + end)
                    size += len(own) // 4 + 1
                    if size >= segment:
                        yield flush()
        if doc_ids:
            yield flush()

    return run


def write(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, segment: int = SEGMENT) -> str:
    """Writes the ids of docs (doc_id, text) in ascending order of doc_id; returns the path."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(partitions(spark), F.asc_nulls_first("doc_id"), "tie")
    rows = rows.sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie").select("doc_id", "text")
    rows.mapInArrow(_write(tokenizer, end_id, segment), SEGMENT_SCHEMA).write.parquet(path)
    return path


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, segment, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            doc_ids, lengths, ids = unpack(data)
            ends = np.cumsum(lengths.astype(np.int64))
            starts = ends - lengths.astype(np.int64)
            raw = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(doc_ids, pa.int64()),
                    pa.array(starts, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64()),
                ],
                names=["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def _read_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            doc_ids, lengths, ids = unpack(data)
            values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), values], names=["doc_id", "ids"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every document, decoded from the files."""
    return _files(spark, path).select("data").mapInArrow(_read_ids, "doc_id long, ids array<int>")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    files = _files(spark, path)
    decoded = files.select("shard", "segment", "data").mapInArrow(
        _read, "shard int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    sizes = files.select("shard", "segment", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", before(Window.orderBy("shard")).alias("base"))
    segments = sizes.withColumnRenamed("n_tokens", "n").withColumn("within", before(Window.partitionBy("shard").orderBy("segment")))
    bases = segments.join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("within")).alias("base"))
    return decoded.join(bases, ["shard", "segment"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
