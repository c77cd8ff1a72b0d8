"""Token ids in binary shards of patched frame-of-reference blocks.

A shard holds consecutive documents. Its ids are cut into blocks of 256; a block's minimum is
subtracted, the rest is packed at the width that a percentile of its values fits, and wider values
go to an exception list (place and value). The index gives each block's start, so any block can be
read alone. Little-endian layout of a shard:

  magic 'PFR1', u32 block, u64 documents, u64 tokens, u64 tokens of earlier shards of its partition
  i64 ids[documents], u8 id_missing[documents], u32 lengths[documents]
  u64 starts[blocks + 1] (in 64-bit words), u32 minima[blocks], u8 widths[blocks], u32 exceptions_from[blocks + 1]
  u64 words[starts[blocks]], u8 places[exceptions], u32 values[exceptions]

Shards are rows of a Parquet table (part, seq, shard), so that Spark's committer writes them once
whatever executor is lost. Ascending (part, seq) is ascending doc_id order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, scratch, share_code
from .tokens import batches_of, encoder

BLOCK = 256
HEAD = struct.Struct("<4sIQQQ")
SHARD_TOKENS = 1 << 20


def _bits(v: np.ndarray) -> np.ndarray:
    """Bit lengths."""
    return np.frexp(v.astype(np.float64))[1].astype(np.uint8)


def pack_blocks(ids: np.ndarray, percentile: float = 0.9) -> tuple[np.ndarray, ...]:
    """starts, minima, widths, exceptions_from, words, places, values of unsigned 32-bit ids."""
    n = -(-len(ids) // BLOCK)
    full = np.zeros((n, BLOCK), dtype=np.uint32)
    full.ravel()[: len(ids)] = ids
    if len(ids) % BLOCK:
        full[-1, len(ids) % BLOCK :] = full[-1, 0]
    minima = full.min(axis=1) if n else np.zeros(0, np.uint32)
    full -= minima[:, None]
    k = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    widths = _bits(np.partition(full, k, axis=1)[:, k]) if n else np.zeros(0, np.uint8)
    out = full > ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    at, places = np.nonzero(out)
    values = full[out]
    full[out] = 0
    starts = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(widths.astype(np.uint64) * (BLOCK // 64), out=starts[1:])
    words = np.zeros(int(starts[-1]), dtype=np.uint64)
    for w in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == w)
        v = np.ascontiguousarray(full[rows].reshape(-1, 64).T).astype(np.uint64)
        packed = np.zeros((w, v.shape[1]), dtype=np.uint64)
        for i in range(64):
            j, s = divmod(i * w, 64)
            packed[j] |= v[i] << np.uint64(s)
            if s + w > 64:
                packed[j + 1] |= v[i] >> np.uint64(64 - s)
        flat = packed.T.reshape(len(rows), -1)
        words[starts[rows].astype(np.int64)[:, None] + np.arange(w * (BLOCK // 64))] = flat
    froms = np.zeros(n + 1, dtype=np.uint32)
    np.cumsum(np.bincount(at, minlength=n), out=froms[1:])
    return starts, minima, widths, froms, words, places.astype(np.uint8), values


def unpack_blocks(n_tokens: int, starts, minima, widths, froms, words, places, values) -> np.ndarray:
    n = len(minima)
    full = np.zeros((n, BLOCK), dtype=np.uint32)
    for w in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == w)
        packed = np.ascontiguousarray(words[starts[rows].astype(np.int64)[:, None] + np.arange(w * (BLOCK // 64))].reshape(-1, w).T)
        v, mask = np.empty((64, packed.shape[1]), dtype=np.uint32), np.uint64((1 << w) - 1)
        for i in range(64):
            j, s = divmod(i * w, 64)
            x = packed[j] >> np.uint64(s)
            if s + w > 64:
                x |= packed[j + 1] << np.uint64(64 - s)
            v[i] = x & mask
        full[rows] = v.T.reshape(len(rows), BLOCK)
    full[np.repeat(np.arange(n), np.diff(froms.astype(np.int64))), places] = values
    full += minima[:, None]
    return full.ravel()[:n_tokens]


def write_shard(ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray, before: int) -> bytes:
    starts, minima, widths, froms, words, places, values = pack_blocks(tokens)
    missing = np.array([x is None for x in ids], dtype=np.uint8)
    parts = [
        HEAD.pack(b"PFR1", BLOCK, len(ids), len(tokens), before), np.array([x or 0 for x in ids], dtype="<i8"), missing, lengths.astype("<u4"),
        starts, minima, widths, froms, words, places, values,
    ]
    return b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """ids of documents, their lengths, their tokens, and the tokens of the partition's earlier shards."""
    magic, block, docs, tokens, before = HEAD.unpack_from(data)
    if magic != b"PFR1" or block != BLOCK:
        raise ValueError("not a shard of this format")
    at, n = HEAD.size, -(-tokens // BLOCK)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    ids, missing, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    starts, minima, widths, froms = take("<u8", n + 1), take("<u4", n), take("u1", n), take("<u4", n + 1)
    words = take("<u8", int(starts[-1]))
    places, values = take("u1", int(froms[-1])), take("<u4", int(froms[-1]))
    return [None if m else i for i, m in zip(ids.tolist(), missing, strict=True)], lengths, unpack_blocks(tokens, starts, minima, widths, froms, words, places, values), before


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> None:
    """Encodes every text, appends end_id, and writes shards in ascending id order at path.

    Null texts count as empty: they hold the end id alone. Null ids come last; rows that repeat an
    id are ordered by a hash of their text. An empty table writes no shard.
    """
    share_code(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        ids, lengths, tokens, size, seq, before = [], [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            data = write_shard(ids, np.concatenate(lengths), np.concatenate(tokens), before)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "n_tokens", "shard"]
            )

        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for lo, hi in batches_of(texts):
                flat, n = enc.encode(texts[lo:hi])
                tokens.append(np.insert(flat, np.cumsum(n), end_id))
                lengths.append((n + 1).astype(np.uint32))
                ids.extend(b.column(0)[lo:hi].to_pylist())
                size += len(tokens[-1])
                if size >= SHARD_TOKENS:
                    yield shard()
                    before, seq, ids, lengths, tokens, size = before + size, seq + 1, [], [], [], 0
        if ids:
            yield shard()
        del ids, lengths, tokens
        release()

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    out = dealt.mapInArrow(encoded, "part int, seq int, n_tokens long, shard binary")
    out.write.option("compression", "none").mode("overwrite").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in the shards at path.

    Only one total for each partition of the writer reaches the driver.
    """
    share_code(spark)
    files = spark.read.schema("part int, seq int, n_tokens long, shard binary").parquet(path)
    totals, run = {}, 0
    for r in sorted(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        totals[r["part"]] = run
        run += r["n"]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids, lengths, tokens, before = read_shard(data.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                raw, stops = memoryview(tokens.astype("<u4").tobytes()), ends.tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip([0, *stops[:-1]], stops, strict=True)]
                starts = ends - lengths + before + totals[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return files.select("part", "shard").mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """What read_tokens gives after write_tokens at path, by default a new shared scratch folder."""
    path = path or scratch(docs.sparkSession) + "/tokens"
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path)
