"""Directly addressable token-id files.

An id is split into chunks of 8 bits, lowest first.  Level k holds chunk k of every
id that has one, a bitmap that says which of them go on, and the bitmap's rank
directory; the last level needs neither.  Token i is read by one byte and one rank
at each level, without decoding its neighbours.

A file holds consecutive documents:

    "DAC1" | levels u32 | documents u64 | tokens u64
    document ids i64[documents] | id is present u8[documents] | end offsets u64[documents]
    for each level: entries u64 | chunks u8[entries] | bitmap | rank directory

bitmap: one bit an entry, lowest bit first, padded to 64-byte blocks; rank
directory: u32 count of set bits before each block.  Both are absent in the last
level.  All integers are little-endian.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import partitions, saved, small_batches
from .tokens import encoder

MAGIC = b"DAC1"
BLOCK_BITS = 512
FILE_TOKENS = 1 << 19
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _ranks(bitmap: np.ndarray) -> np.ndarray:
    ones = _POPCOUNT[bitmap].reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint64)
    return np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4")


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file for documents of the given lengths whose ids stand one after another."""
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        more = rest > 255
        body = [np.array([len(rest)], "<u8").tobytes(), (rest & 255).astype(np.uint8).tobytes()]
        if not more.any():
            levels.append(b"".join(body))
            break
        bits = np.packbits(more, bitorder="little")
        bitmap = np.zeros(-(-len(rest) // BLOCK_BITS) * (BLOCK_BITS // 8), np.uint8)
        bitmap[: len(bits)] = bits
        levels.append(b"".join([*body, bitmap.tobytes(), _ranks(bitmap).tobytes()]))
        rest = rest[more] >> 8
    head = MAGIC + np.array([len(levels)], "<u4").tobytes() + np.array([len(doc_ids), len(ids)], "<u8").tobytes()
    present = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head, named.tobytes(), present.tobytes(), np.cumsum(lengths).astype("<u8").tobytes(), *levels])


class TokenFile:
    """Random access to the tokens of one file."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token file")
        levels = int(np.frombuffer(raw, "<u4", 1, 4)[0])
        documents, self.n_tokens = (int(x) for x in np.frombuffer(raw, "<u8", 2, 8))
        at = 24
        ids = np.frombuffer(raw, "<i8", documents, at)
        at += 8 * documents
        present = np.frombuffer(raw, np.uint8, documents, at)
        at += documents
        self.ends = np.frombuffer(raw, "<u8", documents, at).astype(np.int64)
        at += 8 * documents
        self.doc_ids = [int(i) if p else None for i, p in zip(ids, present, strict=True)]
        self.levels = []
        for k in range(levels):
            n = int(np.frombuffer(raw, "<u8", 1, at)[0])
            chunks = np.frombuffer(raw, np.uint8, n, at + 8)
            at += 8 + n
            bitmap = ranks = None
            if k < levels - 1:
                blocks = -(-n // BLOCK_BITS)
                bitmap = np.frombuffer(raw, np.uint8, blocks * BLOCK_BITS // 8, at)
                at += len(bitmap)
                ranks = np.frombuffer(raw, "<u4", blocks, at)
                at += 4 * blocks
            self.levels.append((chunks, bitmap, ranks))

    def token(self, i: int) -> int:
        """Token i, by one rank at each level it goes on to."""
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK_BITS
            first = block * BLOCK_BITS // 8
            before = int(_POPCOUNT[bitmap[first : i >> 3]].sum()) + int(_POPCOUNT[bitmap[i >> 3] & ((1 << (i & 7)) - 1)])
            i, shift = int(ranks[block]) + before, shift + 8
        return value

    def _rank(self, k: int, i: int) -> int:
        chunks, bitmap, ranks = self.levels[k]
        if i >= len(chunks):
            return len(self.levels[k + 1][0])
        block = i // BLOCK_BITS
        return int(ranks[block]) + int(np.unpackbits(bitmap[block * BLOCK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK_BITS].sum())

    def tokens(self, start: int, end: int, level: int = 0) -> np.ndarray:
        """Tokens start to end-1 of the file, without decoding any other."""
        chunks, bitmap, _ = self.levels[level]
        out = chunks[start:end].astype(np.uint32)
        if bitmap is not None and end > start:
            more = np.unpackbits(bitmap[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start].astype(bool)
            first = self._rank(level, start)
            out[more] |= self.tokens(first, first + int(more.sum()), level + 1) << np.uint32(8)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


FILES = "part int, number int, first_token long, n_docs long, n_tokens long, content binary"
_FILES = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("first_token", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("content", pa.binary())])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, file_tokens: int = FILE_TOKENS, parts: int | None = None) -> DataFrame:
    """Encode documents in ascending (doc_id, text) order to files of the format above.

    docs needs doc_id and text; other columns are ignored.  A null text is empty; a
    null doc_id comes first.  Repeated rows are kept, each with its own ids; an empty
    table gives no files.  The result is the written table of files; first_token
    counts the ids of the same part before the file.  Files are neither compressed nor
    split, so a reader may map one and read any id by a few bytes of it.  One task streams one range of
    doc_ids, so its memory is that of one file.
    """
    small_batches(docs.sparkSession)
    parts = parts or partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        names, lengths, held, size, first, number = [], [], [], 0, 0, 0

        def flush():
            nonlocal names, lengths, held, size, first, number
            ids = np.frombuffer(b"".join(held), "<u4")
            row = [[part], [number], [first], [len(names)], [len(ids)], [pack(ids, names, lengths)]]
            first, number = first + len(ids), number + 1
            names, lengths, held, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(row, _FILES, strict=True)], schema=_FILES)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                names.append(doc_id)
                lengths.append(len(ids) // 4 + 1)
                held += (ids, end)
                size += lengths[-1]
                if size >= file_tokens:
                    yield flush()
        if names:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    # Stored as it is: a file's bytes lie in one piece within the Parquet file and can be mapped.
    return saved(ordered.mapInArrow(run, FILES), "token-files", "uncompressed")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone.

    Only one count for each part goes to the driver; parts are as many as the writer
    was told to use.
    """
    totals = {r[0]: r[1] for r in files.groupBy("part").sum("n_tokens").collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part] = at
        at += totals[part]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                f = TokenFile(content)
                starts = np.concatenate(([0], f.ends[:-1])).astype(np.int64)
                crcs = [zlib.crc32(f.document(k).astype("<u4").tobytes()) for k in range(len(f.ends))]
                columns = [pa.array(f.doc_ids, pa.int64()), pa.array(starts + (base[part] + first)), pa.array(f.ends - starts), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return files.select("part", "first_token", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
