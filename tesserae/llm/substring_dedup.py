"""Removal of word passages that an earlier document holds, by FM-indexes over shards.

A passage is a window of words.  Of the shorter grams inside it, the one with the
smallest hash is its anchor; equal windows have equal anchors.  Anchors that only one
document holds rule their windows out.  The runs of windows on the other anchors
(segments) are dealt to shards by anchor.  Each shard builds an FM-index of its
distinct segments and streams each through it once by backward search, which keeps the
interval of its matching statistics; where they reach a window, the smallest doc_id in
the interval says whether an earlier document holds it.  Windows on an
anchor that very many documents hold are dealt one by one, by their own hash, each
distinct one once, and their answers are joined back, so that no shard holds them all.
Copies of one sequence of words are one text with the smallest of their doc_ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import partitions, saved, small_batches
from .fm_index import FMIndex

WINDOW, GRAM = 13, 5
HOT = 5_000
SHARD_WORDS = 300_000  # of one index
SHARD_BYTES = 4 << 20  # of compressed texts, on average
POSTINGS = 1 << 20
BLOB_BYTES = 1 << 24


def anchors(hashes: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window of every document: its document, first word, anchor's place and anchor.

    hashes: all words' hashes; ends: where each document's words end.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    grams = H.windows(hashes, gram)
    best, place = grams[:n].copy(), np.zeros(n, np.int8)
    for k in range(1, window - gram + 1):
        other = grams[k : k + n]
        less = other < best
        best[less] = other[less]
        place[less] = k
    first = np.arange(n)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:n]
    inside = first + window <= ends[doc]
    return doc[inside], first[inside], (first + place)[inside], best[inside]


def _postings(window: int, gram: int) -> Callable:
    """Rows (kind, x, y, n): 0 an anchor x, a text y that holds it, and how many of the task's
    do; 1 an anchor x found in text y of several in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            x, y = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            keep = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            x, y = x[keep], y[keep]
            head = np.append(True, x[1:] != x[:-1])
            n = np.diff(np.append(np.flatnonzero(head), len(x)))
            many = np.repeat(n > 1, n)
            for kind, a, b, c in ((0, x[head], y[head], n), (1, x[many], y[many], np.ones(int(many.sum()), np.int64))):
                for k in range(0, len(a), 50_000):
                    part = slice(k, k + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[part]), kind, np.int32)), pa.array(a[part]), pa.array(b[part]), pa.array(c[part])], names=["kind", "x", "y", "n"])

        for batch in batches:
            words = [(t or "").encode().split() for t in batch.column(0).to_pylist()]
            named = np.array([_content(_digest(w)) for w in words], np.int64)
            hashes, offsets = H.words([b" ".join(w) for w in words])
            doc, _, place, anchor = anchors(hashes, offsets[1:], window, gram)
            new = np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))[: len(doc)]
            held.append((anchor[new].view(np.int64), named[doc[new]]))
            size += int(new.sum())
            if size >= POSTINGS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _shared(hot: int) -> Callable:
    """Over postings sorted by x: rows (kind, x, y) of anchors in several texts (1), and of
    anchors in more than `hot` (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None

        def emit(x, y, n):
            head = np.append(True, x[1:] != x[:-1])
            at = np.flatnonzero(head)
            group = np.cumsum(head) - 1
            several = np.add.reduceat((y != y[at][group]).astype(np.int64), at) > 0
            hit, hots = several[group], at[np.add.reduceat(n, at) > hot]
            columns = [np.concatenate([np.full(int(hit.sum()), 1, np.int32), np.full(len(hots), 2, np.int32)]), np.concatenate([x[hit], x[hots]]), np.concatenate([y[hit], y[hots]])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "x", "y"])

        for batch in batches:
            kind, x, y, n = (c.to_numpy() for c in batch.columns)
            passed = kind == 1
            if passed.any():
                yield pa.RecordBatch.from_arrays([pa.array(kind[passed]), pa.array(x[passed]), pa.array(y[passed])], names=["kind", "x", "y"])
            x, y, n = x[~passed], y[~passed], n[~passed]
            if left is not None:
                x, y, n = (np.concatenate(c) for c in zip(left, (x, y, n), strict=True))
            if len(x):
                other = np.flatnonzero(x != x[-1])
                last = int(other[-1]) + 1 if len(other) else 0
                if last:
                    yield emit(x[:last], y[:last], n[:last])
                left = [x[last:], y[last:], n[last:]]
        if left is not None and len(left[0]):
            yield emit(*left)

    return run


def _zip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unzip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


class _Segments:
    """The segments of a batch of documents: documents (places in the batch), keys, whether they
    are single windows of hot anchors, first words, and their words."""

    def __init__(self, texts: list[bytes], shared: list[np.ndarray], hot: list[np.ndarray], window: int, gram: int):
        plain = [b" ".join(t.split()) for t in texts]
        hashes, offsets = H.words(plain)
        doc, first, place, anchor = anchors(hashes, offsets[1:], window, gram)
        wanted = self._marked(doc, anchor, shared)
        doc, first, place, anchor = doc[wanted], first[wanted], place[wanted], anchor[wanted]
        alone = self._marked(doc, anchor, hot)
        start = np.append(True, (np.diff(place) != 0) | (np.diff(first) != 1) | (np.diff(doc) != 0) | alone[1:])[: len(doc)]
        at = np.flatnonzero(start)
        last = first[np.append(at[1:], len(first))[: len(at)] - 1]
        self.doc, self.hot, begin, end = doc[at], alone[at], first[at], last + window
        self.first = begin - offsets[self.doc]
        self.key = anchor[at].copy()
        self.key[self.hot] = H.mix(H.windows(hashes, window)[begin[self.hot]])
        self.key = self.key.view(np.int64)
        self.n_words = end - begin
        self.raw = b" ".join(p for p in plain if p) + b" "
        gaps = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 32)
        self.begin = np.append(0, gaps + 1)[begin] if len(begin) else begin
        self.end = gaps[end - 1] if len(end) else end

    @staticmethod
    def _marked(doc: np.ndarray, anchor: np.ndarray, of: list[np.ndarray]) -> np.ndarray:
        sizes = [len(x) for x in of]
        if not sum(sizes) or not len(doc):
            return np.zeros(len(doc), bool)
        marks = H.combine(np.concatenate(of).view(np.uint64), np.repeat(np.arange(len(of)), sizes).astype(np.uint64))
        return np.isin(H.combine(anchor, doc.astype(np.uint64)), marks)

    def words(self, which: np.ndarray) -> list[bytes]:
        raw = self.raw
        return [raw[a:b] for a, b in zip(self.begin[which].tolist(), self.end[which].tolist(), strict=True)]


def earliest(segments: list[bytes], least: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of the ids `least` over the segments that hold each window, for all windows of
    all segments in order; and where each segment's windows begin."""
    names: dict[bytes, int] = {}
    name = names.setdefault
    split = [s.split(b" ") for s in segments]
    symbols = np.array([name(w, len(names) + 1) for s in split for w in s], np.int64)
    sizes = np.array([len(s) for s in split], np.int64)
    ends = np.cumsum(sizes)
    index = FMIndex(np.split(symbols, ends[:-1]), len(names))
    low, high = index.matches(window)
    return index.least(low, high, least), np.cumsum(sizes - window + 1) - (sizes - window + 1)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _content(digest: str) -> int:
    """64 bits of a text's digest, as the name that its copies share."""
    return int(digest[:16], 16) - (1 << 63)


GONE = "g_doc long, g_row long, first int, hit binary"
_GONE = pa.schema([("g_doc", pa.int64()), ("g_row", pa.int64()), ("first", pa.int32()), ("hit", pa.binary())])


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: words of windows an earlier document holds are removed.

    docs needs doc_id and text; other columns are ignored.  Words are runs of anything
    but 0x20 and 0x09-0x0D, unchanged.  A window is removed if a document with a smaller
    doc_id holds it, judged on the input; windows repeated within a document alone stay.
    Null and blank texts have no words.  Rows without a doc_id lose nothing and take
    nothing from others; rows with one doc_id take nothing from each other.  An empty
    table gives no rows.  Grams choose candidates by 64-bit hashes; the indexes hold the
    words themselves.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = partitions(spark)
    rows = docs.select("doc_id", "text").withColumn("row", F.xxhash64("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t or "").encode().split() for t in batch.column(2).to_pylist()]
            digests = [_digest(w) for w in words]
            content = pa.array([_content(d) for d in digests], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array(digests, pa.string()), content], names=["doc_id", "row", "n_words", "whole_sha256", "content"])

    base = saved(rows.select("doc_id", "row", "text").mapInArrow(whole, "doc_id long, row long, n_words long, whole_sha256 string, content long"), "dedup-rows")
    texts = base.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).groupBy("whole_sha256", "content").agg(F.min("doc_id").alias("rep"))

    usable = rows.where("doc_id is not null and text is not null")
    postings = usable.select("text").mapInArrow(_postings(window, gram), "kind int, x long, y long, n long")
    dealt = postings.repartition(parts, "x").sortWithinPartitions("x")
    found = saved(dealt.mapInArrow(_shared(hot), "kind int, x long, y long"), "dedup-anchors")
    hots = found.where("kind = 2").select(F.col("x").alias("h")).distinct()
    hits = found.where("kind = 1").select("x", "y").join(hots, F.col("x") == F.col("h"), "left")
    hits = hits.groupBy("y").agg(F.collect_set("x").alias("shared"), F.collect_set("h").alias("hot"))
    hits = hits.join(texts.select("content", "rep"), F.col("y") == F.col("content")).select("rep", F.col("content").alias("named"), "shared", "hot")

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [b" ".join(t.encode().split()) for t in batch.column(2).to_pylist()]
            texts = pa.array([_zip(t) for t in plain], pa.binary())
            content = pa.array([_content(_digest([t])) for t in plain], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, content], names=["doc_id", "row", "zipped", "content"])

    small = usable.select("doc_id", "row", "text").mapInArrow(zipped, "doc_id long, row long, zipped binary, content long")
    candidates = small.hint("merge").join(hits, (F.col("doc_id") == F.col("rep")) & (F.col("content") == F.col("named")))
    candidates = saved(candidates.select("doc_id", "row", "zipped", "shared", "hot"), "dedup-candidates")

    # As many shards as hold some SHARD_BYTES of compressed texts each, so that a shard's size is bounded.
    held_bytes = candidates.agg(F.sum(F.octet_length("zipped"))).first()[0] or 0
    shards_n = max(parts, -(-held_bytes // SHARD_BYTES))

    def cut(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, _Segments]:
        ids, row = (np.array(batch.column(k).to_pylist(), np.int64) for k in (0, 1))
        lists = [[np.array(x, np.int64) for x in batch.column(k).to_pylist()] for k in (3, 4)]
        return ids, row, _Segments([_unzip(z) for z in batch.column(2).to_pylist()], *lists, window, gram)

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of anchors that aren't hot, as compressed tables, one for each shard and flush."""
        held: list[pa.Table] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.concat_tables(held).combine_chunks()
            shard = (H.mix(table.column("key").to_numpy().view(np.uint64)) % np.uint64(shards_n)).astype(np.int64)
            order = np.lexsort((table.column("key").to_numpy(), shard))
            table, shard = table.take(pa.array(order)), shard[order]
            at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            blobs = []
            for a, b in zip(at, np.append(at[1:], len(shard)), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table.slice(a, b - a))
                blobs.append(_zip(sink.getvalue().to_pybytes()))
            return pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(blobs, pa.binary())], names=["shard", "blob"])

        for batch in batches:
            ids, row, s = cut(batch)
            which = np.flatnonzero(~s.hot)
            if len(which):
                columns = {"key": s.key[which], "doc": ids[s.doc[which]], "row": row[s.doc[which]], "first": s.first[which].astype(np.int32)}
                held.append(pa.table({**columns, "words": pa.array(s.words(which), pa.binary())}))
                size += held[-1].nbytes
            if size >= BLOB_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def search_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index and search the segments of each shard; rows come sorted by shard, and one is held at a time."""
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, own in groupby(rows, key=itemgetter(0)):
            blobs = [blob for _, blob, _ in own]
            yield from searched(blobs)

    def searched(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        # Keys are dealt to passes by hash, and each pass unpacks the blobs anew, so that it holds its own words alone.
        words = sum(_words_in(b) for b in blobs)
        passes = max(1, -(-words // SHARD_WORDS))
        for p in range(passes):
            kept = []
            for blob in blobs:
                t = pa.ipc.open_stream(_unzip(blob)).read_all()
                turn = ((H.mix(t.column("key").to_numpy().view(np.uint64)) >> np.uint64(40)) % np.uint64(passes)).astype(np.int64)
                kept.append(t.filter(pa.array(turn == p)))
            part = pa.concat_tables(kept).combine_chunks()
            if len(part):
                yield _answers(part, window)

    shards = candidates.mapInArrow(to_shards, "shard long, blob binary").withColumn("spot", F.xxhash64("blob"))
    shards = shards.repartition(parts, "shard").sortWithinPartitions("shard", "spot")
    gone = saved(shards.mapInArrow(search_shard, GONE), "dedup-windows")

    def hot_windows(with_words: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, row, s = cut(batch)
                which = np.flatnonzero(s.hot)
                if len(which):
                    doc = s.doc[which]
                    more = [pa.array(s.words(which), pa.binary())] if with_words else [pa.array(row[doc]), pa.array(s.first[which].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([pa.array(s.key[which]), pa.array(ids[doc]), *more], names=["key", "doc_id", "words"] if with_words else ["key", "doc_id", "row", "first"])

        return run

    def search_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index and search distinct hot windows, sorted by key, some at a time."""
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            least, _ = earliest(t.column("words").to_pylist(), t.column("doc_id").to_numpy(), window)
            return pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), t.column("words").combine_chunks(), pa.array(least)], names=["s_key", "s_words", "earliest"])

        for batch in batches:
            if sum(b.num_rows for b in held) * window >= SHARD_WORDS:
                yield flush()
                held = []
            if batch.num_rows:
                held.append(batch)
        if held:
            yield flush()

    warm = candidates.where(F.size("hot") > 0)
    distinct = warm.mapInArrow(hot_windows(True), "key long, doc_id long, words binary").groupBy("key", "words").agg(F.min("doc_id").alias("doc_id"))
    told = distinct.repartition(parts, "key").select("key", "words", "doc_id").mapInArrow(search_hot, "s_key long, s_words binary, earliest long")
    told = saved(told.groupBy("s_key").agg(F.min("earliest").alias("earliest")), "dedup-hot")
    placed = warm.mapInArrow(hot_windows(False), "key long, doc_id long, row long, first int")
    late = placed.join(told, F.col("key") == F.col("s_key")).where(F.col("earliest") < F.col("doc_id"))
    late = late.select(F.col("doc_id").alias("g_doc"), F.col("row").alias("g_row"), "first", F.lit(b"\x01").alias("hit"))
    pieces = gone.union(late).groupBy("g_doc", "g_row").agg(F.collect_set(F.struct("first", "hit")).alias("gone"))

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_unzip(z).split() for z in batch.column(2).to_pylist()]
            starts = np.cumsum([0] + [len(w) + 1 for w in words])
            pieces = batch.column(3).flatten()
            doc = np.repeat(np.arange(len(words)), batch.column(3).value_lengths().to_numpy())
            hits = pieces.field("hit").to_pylist()
            sizes = np.array([len(h) for h in hits], np.int64)
            ends = np.cumsum(sizes)
            place = np.repeat(starts[doc] + pieces.field("first").to_numpy() - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
            place = place[np.frombuffer(b"".join(hits), np.uint8) > 0]
            edge = np.zeros(starts[-1] + 1, np.int64)
            np.add.at(edge, place, 1)
            np.subtract.at(edge, place + window, 1)
            stays = np.cumsum(edge) == 0
            kept = [list(compress(w, stays[a : a + len(w)].tolist())) for w, a in zip(words, starts[:-1].tolist(), strict=True)]
            gone_words = pa.array([len(w) - len(k) for w, k in zip(words, kept, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), gone_words, pa.array([_digest(k) for k in kept], pa.string())], names=["k_doc", "k_row", "n_removed", "kept"])

    struck = candidates.join(pieces, (F.col("doc_id") == F.col("g_doc")) & (F.col("row") == F.col("g_row"))).select("doc_id", "row", "zipped", "gone")
    struck = struck.mapInArrow(strike, "k_doc long, k_row long, n_removed long, kept string").dropDuplicates(["k_doc", "k_row"])
    firsts = texts.select(F.col("whole_sha256").alias("t_sha256"), "rep")
    out = base.join(firsts, F.col("whole_sha256") == F.col("t_sha256"), "left")
    out = out.join(struck, (F.col("doc_id") == F.col("k_doc")) & (F.col("row") == F.col("k_row")), "left")
    copied = F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False))  # an earlier copy holds every window
    removed = F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    kept_sha = F.when(copied, F.lit(_digest([]))).otherwise(F.coalesce("kept", "whole_sha256"))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), kept_sha.alias("kept_sha256"))


def _words_in(blob: bytes) -> int:
    return pa.ipc.open_stream(_unzip(blob)).read_all().column("words").nbytes // 6


def _answers(part: pa.Table, window: int) -> pa.RecordBatch:
    """Of one pass's segments, those with windows that an earlier document holds."""
    words = part.column("words").combine_chunks().dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    which = words.indices.to_numpy()
    segments = words.dictionary.to_pylist()
    doc = part.column("doc").to_numpy()
    least = np.full(len(segments), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    found, at = earliest(segments, least, window)
    ends = np.append(at[1:], len(found))
    rows, first = part.column("row").to_numpy(), part.column("first").to_numpy()
    lowest = np.minimum.reduceat(found, at)
    late = np.flatnonzero(lowest[which] < doc)
    hits = [(found[at[w] : ends[w]] < d).astype(np.uint8).tobytes() for w, d in zip(which[late].tolist(), doc[late].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(doc[late]), pa.array(rows[late]), pa.array(first[late]), pa.array(hits, pa.binary())], schema=_GONE)
