"""Packing of documents into fixed-length sequences along a Hilbert curve."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches
from .tokens import CACHE_PIECES, encoder, release

DIMS, BITS, BUCKETS = 3, 10, 256
_SIGNS = np.random.default_rng(7).choice(np.array([-1.0, 1.0]), size=(BUCKETS, DIMS))


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of rows of non-negative integers below 2**bits.

    Gray-code form: walk from the top bit down, undo the reflection or exchange that
    each visited cell applies to the cells inside it, then interleave the bits.
    """
    x = np.array(points, dtype=np.int64, copy=True)
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            on = (x[:, d] & bit) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip[:, None]
    out = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[:, d] >> level) & 1)
    return out


def curve_keys(texts: list[bytes | None]) -> np.ndarray:
    """Hilbert key of each text: hashed counts of its 4-byte windows, square-rooted,
    scaled to length 1, projected by fixed random signs, and quantised."""
    raws = [np.frombuffer(t or b"", dtype=np.uint8) for t in texts]
    counts = np.zeros((len(raws), BUCKETS))
    for k, raw in enumerate(raws):
        for at in range(0, max(0, len(raw) - 3), 1 << 20):
            part = raw[at : at + (1 << 20) + 3].astype(np.uint32)
            grams = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16 | part[3:] << 24
            counts[k] += np.bincount((grams * np.uint32(2654435761)) >> 24, minlength=BUCKETS)
    vectors = np.sqrt(counts)
    vectors /= np.maximum(np.sqrt(counts.sum(axis=1, keepdims=True)), 1)
    flat = vectors @ _SIGNS
    cells = np.floor((0.5 + np.arctan(flat) / np.pi) * (1 << BITS)).astype(np.int64)
    return hilbert_index(np.clip(cells, 0, (1 << BITS) - 1), BITS)


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long"
_OUT = pa.schema([(c.split()[0], pa.int64()) for c in OUT.split(", ")])


def pack_along_curve(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, parts: int | None = None, cache: int = CACHE_PIECES, keep: bool = True) -> DataFrame:
    """Order documents by the Hilbert key of their hashed vectors and fill sequences in that order.

    docs needs doc_id and text; other columns are ignored.  A null text is empty and
    holds the end id alone.  Each document's ids are cut where a sequence of `length`
    is full, so only the last ids of a task are left; those fill sequences of powers
    of two, largest first.  Documents on one key (exact copies) are spread over tasks
    by a hash of doc_id, and repeated rows by the part of the input that holds them; each
    is packed.  A text may be as long as a row can be.  An empty table gives no rows.
    cache bounds the words that a worker remembers; without keep it forgets them, and the
    vocabulary, after each task.
    """
    small_batches(docs.sparkSession)
    parts = parts or partitions(docs.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else t.encode() for t in batch.column(1).to_pylist()]
            key = pa.array(curve_keys(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), key], names=["doc_id", "text", "curve_key"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, cache).encode, np.array([end_id], "<u4").tobytes()
        sequence, rows, tail, used = TaskContext.get().partitionId() << 40, [], [], 0

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_OUT)

        for batch in batches:
            for doc_id, ids, key in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
                ids += end
                total, at = len(ids) // 4, 0
                while at < total:
                    n = min(length - used, total - at)
                    tail.append((doc_id, at, ids[4 * at : 4 * (at + n)], total, key))
                    used, at = used + n, at + n
                    if used == length:
                        rows += _place(tail, sequence, [length])
                        sequence, tail, used = sequence + 1, [], 0
            if rows:
                yield out(rows)
                rows = []
        if tail:
            yield out(_place(tail, sequence, [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]))
        if not keep:
            del encode
            release()

    shape = "doc_id long, text string, curve_key long"
    ordered = docs.select("doc_id", "text").mapInArrow(keyed, shape).withColumns({"tie": F.xxhash64("doc_id"), "part": F.spark_partition_id()})
    ordered = ordered.repartitionByRange(parts, "curve_key", "tie", "part").sortWithinPartitions("curve_key", "tie", "doc_id", "part").drop("tie", "part")
    return ordered.mapInArrow(fill, OUT)


def _place(pieces: list[tuple], sequence: int, sizes: list[int]) -> list[tuple]:
    """Rows for pieces laid end to end over sequences of the given sizes."""
    rows, k, used = [], 0, 0
    for doc_id, start, ids, total, key in pieces:
        while ids:
            n = min(sizes[k] - used, len(ids) // 4)
            rows.append((doc_id, start, n, zlib.crc32(ids[: 4 * n]), total, sequence + k, used, key))
            start, ids, used = start + n, ids[4 * n :], used + n
            if used == sizes[k]:
                k, used = k + 1, 0
    return rows
