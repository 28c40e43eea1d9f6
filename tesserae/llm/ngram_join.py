"""Self-join of documents on the Jaccard similarity of their word shingles.

Candidates: a pair at similarity t differs in few shingles, so of one part more than
that, dealt by hash, some part is the same in both.  A set leaves out the parts that most
sets share, as many as it can spare: the rarest part of a linked pair is kept by both.
Sets that keep a part meet at the part's first set.  A part that more than HOT sets share
comes first in that order; only sets that can't spare all of those they hold (most of
their parts are common ones) meet by common parts too, in blocks.  Where sets meet, a T-occurrence search finds the exact links: short
inverted lists are merged as sorted runs, long ones probed by binary search (DivideSkip),
and sets that reach the required overlap are kept.  Sets and queries enter it by their
difference from what most sets of the block hold, so what all share costs nothing.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import partitions, saved, small_batches
from .components import components

HOT = 60  # sets that may share a part before it is left out
BLOCK = 200
SHINGLES = 1 << 20  # of the sets of a block that meet by common parts, where no block is given
SALTS = 16
FEW = 50_000  # rows of ids that may be broadcast
GROWTH = 1.5
POSTINGS = 1 << 20


def _bounds(top: int = 1 << 40) -> list[int]:
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


_BOUNDS = _bounds()


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles, A-Z taken as a-z."""
    hashes, at = H.words([None if t is None else t.encode() for t in texts], lower=True)
    out = []
    for k in range(len(texts)):
        w = hashes[at[k] : at[k + 1]]
        if 0 < len(w) < width:
            whole = w[:1]
            for x in w[1:]:
                whole = H.combine(whole, np.array([x]))
            out.append(H.mix(whole + np.uint64(len(w))))
        else:
            out.append(np.unique(H.windows(w, width)))
    return out


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(H.mix(np.array([H.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64))


def _levels(s: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """The size levels that the set signs: each with what it can differ in, the number of parts, and each shingle's part."""
    n, high = len(s), s >> np.uint64(20)
    for j in range(bisect_right(_BOUNDS, n) - 1, bisect_right(_BOUNDS, n * den // num)):
        top = _BOUNDS[j + 1] - 1
        differ = 2 * top * (den - num) // (den + num)
        parts = 1 if not differ else differ + 2 + differ // 20
        yield j, (n + min(n * den // num, top)) * (den - num) // (den + num), parts, (high % np.uint64(parts)).astype(np.int64)


def spares(s: np.ndarray, num: int, den: int) -> list[tuple[int, int, np.ndarray]]:
    """For each size level that the set signs: its parity, how many of its parts may be left
    out with every partner still met, and the signatures of its parts.

    A pair at num/den or more signs the level of its larger set with equally many parts.
    They differ in at most (own) shingles, each of which spoils one part.
    """
    out = []
    spread = H.mix(s)
    for j, own, parts, part in _levels(s, num, den):
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part, spread)
        used = np.flatnonzero(np.bincount(part, minlength=parts))
        out.append((j & 1, len(used) - own - 1, H.combine(sums[used], (used + (j << 40)).astype(np.uint64))))
    return out


def least_spares(s: np.ndarray, num: int, den: int) -> dict[int, int]:
    """The smallest number of parts that may be left out at the levels of each parity."""
    out: dict[int, int] = {}
    for j, own, parts, part in _levels(s, num, den):
        spare = np.count_nonzero(np.bincount(part, minlength=parts)) - own - 1
        out[j & 1] = min(spare, out.get(j & 1, spare))
    return out


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures such that any two sets at similarity num/den or more share one.

    The lowest bit is the level's parity; the next one is clear.  A set with too few parts
    at a level also signs by its first shingles, and by the parity alone (0 or 1), which
    marks it.
    """
    out = []
    for parity, spare, x in spares(s, num, den):
        out.append(x & ~np.uint64(3) | np.uint64(parity))
        if spare < 0:
            first = H.mix(s[: len(s) - -(-num * len(s) // den) + 1] + np.uint64(0x51))
            out += [first & ~np.uint64(3) | np.uint64(parity), np.array([parity], np.uint64)]
    return np.concatenate(out)


class Lists:
    """Inverted lists of a block of sets, each set taken by its difference from the block's core.

    The core is what more than half of the sets hold.  Sets differ from each other as their
    differences from it do, so the lists hold, of a shingle in the core, the sets without it:
    alike sets have short lists, however many they are.  Without a core they are the plain lists.
    """

    def __init__(self, sets: list[np.ndarray]):
        n = len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], np.repeat(np.arange(n, dtype=np.int32), self.sizes)[order]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)])
        held = np.diff(np.append(first, len(tokens)))
        self.tokens, self.core = tokens[first], 2 * held > n
        self.lengths = np.where(self.core, n - held, held)
        self.ends = np.append(0, np.cumsum(self.lengths))
        inner = np.repeat(self.core, held)
        has = np.zeros((int(self.core.sum()), n), bool)
        has[np.repeat(np.arange(len(has)), held[self.core]), owner[inner]] = True
        self.owner = np.zeros(self.ends[-1], np.int32)
        swapped = np.repeat(self.core, self.lengths)
        self.owner[~swapped], self.owner[swapped] = owner[~inner], np.nonzero(~has)[1]
        self.shared = has.sum(axis=0)
        self.differing = np.bincount(self.owner, minlength=n)

    def links(self, query: np.ndarray, num: int, den: int, inside: bool = False) -> np.ndarray:
        """Sets of the block at similarity num/den or more with the query.

        inside: the query is one of the sets, so a list of a single set is its own and
        joins it with none.
        """
        n = len(query)
        if not n or not len(self.tokens):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        differs = self.core.copy()
        at = at[self.tokens[at] == query]
        differs[at] = ~self.core[at]
        # A pair's overlap is what it shares of its differences, less the core's shingles, plus what each holds of these.
        need = -(-num * (n + self.sizes) // (num + den)) + len(self.core[self.core]) - int(self.core[at].sum()) - self.shared
        alike = (num * n <= den * self.sizes) & (num * self.sizes <= den * n)
        sure = np.flatnonzero(alike & (need <= 0))
        mine = np.flatnonzero(differs & (self.lengths > inside))
        unsure = alike & (need > 0) & (need <= np.minimum(self.differing, len(mine)))
        if not unsure.any():
            return sure
        least = int(need[unsure].min())
        mine = mine[np.argsort(self.lengths[mine], kind="stable")]
        n_long = min(least - 1, int(least / (0.05 * np.log2(int(self.lengths[mine[-1]]) + 1) + 1)))
        lists = [self.owner[self.ends[k] : self.ends[k + 1]] for k in mine]
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        merged = np.sort(np.concatenate(short), kind="stable")
        edges = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
        owners, overlap = merged[edges].astype(np.int64), np.diff(np.append(edges, len(merged)))
        alive = unsure[owners] & (overlap + n_long >= need[owners])
        owners, overlap = owners[alive], overlap[alive]
        for k, x in enumerate(reversed(long)):
            if not len(owners):
                break
            overlap = overlap + (x[np.minimum(np.searchsorted(x, owners), len(x) - 1)] == owners)
            alive = overlap + (len(long) - 1 - k) >= need[owners]
            owners, overlap = owners[alive], overlap[alive]
        return np.sort(np.concatenate([sure, owners]))


def link_block(keys: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """(key, root key) of every set that is linked within the block, found by as few searches as show it.

    The set that differs least from the block's core is searched first; then every set
    outside its component.  A pair within one component needs no search, and any other
    pair has a side that is searched.
    """
    parent = list(range(len(keys)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = Lists(sets)
    order = np.argsort(lists.differing, kind="stable").tolist()
    lead = order[0]
    for k in order:
        if k == lead or find(k) != find(lead):
            for y in lists.links(sets[k], num, den, True).tolist():
                a, b = find(k), find(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return [(keys[k], keys[find(k)]) for k in range(len(keys)) if find(k) != k]


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first n_keys columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def _out(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))


def _postings(width: int, num: int, den: int, hot: int) -> Callable:
    """Rows (x, y): a signature and a set that has it, once for the copies that a task reads.

    Of a signature that more than `hot` of a task's sets have, the further rows are marked
    by its second bit: they needn't meet the others to be known as common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig, key = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((key, sig))
            sig, key = sig[order], key[order]
            new = np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]))
            sig, key = sig[new], key[new]
            place = np.arange(len(sig))
            head = np.maximum.accumulate(np.where(np.append(True, sig[1:] != sig[:-1]), place, 0))
            sig = np.where(place - head > hot, sig | 2, sig)
            for at in range(0, len(sig), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(sig[at : at + 50_000]), pa.array(key[at : at + 50_000])], names=["x", "y"])

        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist(), width):
                if len(s):
                    sig = signatures(s, num, den).view(np.int64)
                    held.append((sig, np.full(len(sig), set_key(s))))
                    size += len(sig)
            if size >= POSTINGS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


MEETINGS = "common boolean, x long, a long, b long"
_MEETINGS = pa.schema([("common", pa.bool_()), ("x", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _parts(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """Postings sorted by both columns as runs (common, signature, set, number of the signature's sets).

    A signature of more than `hot` sets is common, and its number is one more than that; the
    others come whole, each set once.  A common signature's rows pass by, so it takes time but no memory.
    """
    none = np.zeros(0, np.int64)
    left_x, left_y, passing = none, none, None

    def common(x: np.ndarray, y: np.ndarray) -> tuple[bool, np.ndarray, np.ndarray, np.ndarray]:
        return True, x, y, np.full(len(x), hot + 1)

    for batch in itertools.chain(batches, [None]):
        x, y = (none, none) if batch is None else (c.to_numpy() for c in batch.columns)
        known = (x & 2) != 0
        if known.any():
            yield common(x[known] & ~2, y[known])
            x, y = x[~known], y[~known]
        x, y = np.concatenate([left_x, x]), np.concatenate([left_y, y])
        new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
        x, y = x[new], y[new]
        if passing is not None and len(x):
            more = x == passing
            if more.any():
                yield common(x[more], y[more])
                x, y = x[~more], y[~more]
            if len(x):
                passing = None
        last = len(x) if batch is None or not len(x) else int(np.searchsorted(x, x[-1]))
        if len(x) - last > hot:
            last, passing = len(x), x[-1]
        left_x, left_y, x, y = x[last:], y[last:], x[:last], y[:last]
        if not len(x):
            continue
        at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        n = np.diff(np.append(at, len(x)))
        wide = np.repeat((n > hot) | (x[at] >> 1 == 0), n)
        if passing is not None:
            wide |= x == passing
        if wide.any():
            yield common(x[wide], y[wide])
        if not wide.all():
            yield False, x[~wide], y[~wide], np.repeat(n, n)[~wide]


SHARED = "x long, y long, n long"


def _shared(hot: int) -> Callable:
    """Over sorted postings: (signature, set, number of its sets) of each signature that two sets or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, y, n in _parts(batches, hot):
            two = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(c[two]) for c in (x, y, n)], names=["x", "y", "n"])

    return run


def _meetings(hot: int) -> Callable:
    """Over sorted postings: for a signature of at most `hot` sets, rows (false, name of its
    sets, further set, first set); for any other, rows (true, signature, set, set).
    """

    def rows(common: bool, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), common)), pa.array(x), pa.array(a), pa.array(b)], schema=_MEETINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for common, x, y, _ in _parts(batches, hot):
            if common:
                yield rows(True, x, y, y)
                continue
            at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            n = np.diff(np.append(at, len(x)))
            named = H.mix(np.add.reduceat(H.mix(y.view(np.uint64)), at) + n.astype(np.uint64)).view(np.int64)
            first = np.repeat(y[at], n)
            other = first != y
            if other.any():
                yield rows(False, np.repeat(named, n)[other], y[other], first[other])

    return run


def _kept(shared: DataFrame, reps: DataFrame, hot: int) -> DataFrame:
    """x, y, n of the parts that a set keeps, the number of its common parts, and its size.

    Of a set's parts at levels of one parity, those that most sets share are left out, as many
    as it can spare; the order is one for all sets.  A linked pair shares more parts than
    either can spare, so both keep the last in that order of those that they share.
    """
    parity = F.col("x").bitwiseAND(F.lit(1))
    rows = shared.where(F.col("n") <= hot).union(shared.where(F.col("n") > hot).distinct())
    rows = rows.join(reps.select(F.col("key").alias("y"), "even", "odd", "size"), "y")
    rank = F.row_number().over(Window.partitionBy("y", parity).orderBy(F.desc("n"), "x"))
    parts = F.sum((F.col("n") > hot).cast("long")).over(Window.partitionBy("y"))
    rows = rows.select("x", "y", "n", "size", parts.alias("parts"), (rank > F.when(parity == 0, F.col("even")).otherwise(F.col("odd"))).alias("held"))
    return rows.where("held").drop("held")


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, block: int | None = None, hot: int = HOT, mark: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id: components of documents whose sets are at num/den or more.

    mark: a long of each row that is to be returned with it.

    docs needs doc_id and text; other columns are ignored.  With fewer words than width
    the whole sequence is one shingle; null and blank texts have none and stand alone.
    component_id is the smallest doc_id reachable by links, the document's own
    included.  Rows without a doc_id aren't compared and get a null component_id; rows
    repeated or of equal sets are one set.  A text may be as long as a row can be: its set
    is made of all its words.  A pair at exactly num/den is linked.  An empty table gives
    no rows.

    Sets are named by 64-bit hashes.  A text goes to the first sets of the parts that it keeps,
    at most `hot` sets a part; a first set with more than `block` others (BLOCK, if not
    given) meets those of each part by themselves.  Sets that meet by common parts are dealt
    over blocks of that many sets (if not given, of SHINGLES shingles, BLOCK sets at least);
    the one with the most such parts is in every block.  Those outside the largest component
    are then searched in all blocks, so no link between different components is lost.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = partitions(spark)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            keys = [set_key(s) if len(s) else None for s in sets]
            spare = [least_spares(s, num, den) if len(s) else {} for s in sets]
            columns = [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x.get(p) for x in spare], pa.int64()) for p in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], names=["doc_id", "key", "n_shingles", "even", "odd", "mark"])

    plain = docs.select("doc_id", "text")
    marked = docs.select("doc_id", "text", (F.lit(0) if mark is None else mark).cast("long").alias("mark"))
    all_docs = saved(marked.mapInArrow(named, "doc_id long, key long, n_shingles long, even long, odd long, mark long"), "join-docs")
    reps = all_docs.where("doc_id is not null and key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("even").alias("even"), F.min("odd").alias("odd"), F.max("n_shingles").alias("size"))
    reps = saved(reps, "join-reps")

    postings = plain.where("doc_id is not null").select("text").mapInArrow(_postings(width, num, den, hot), "x long, y long")
    spread = F.when(F.col("x").bitwiseAND(F.lit(2)) == 0, F.col("x")).otherwise(F.col("y"))
    dealt = postings.repartition(parts, spread).sortWithinPartitions("x", "y")
    shared = saved(dealt.mapInArrow(_shared(hot), SHARED), "join-shared")
    kept = saved(_kept(shared, reps, hot), "join-kept")
    scarce = kept.where(F.col("n") <= hot).select("x", "y").repartition(parts, "x").sortWithinPartitions("x", "y")
    met = saved(scarce.mapInArrow(_meetings(hot), MEETINGS), "join-meetings")

    # Parts that few sets share: a first set and its others, or one part's where they are many.
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("b").alias("w")).agg(F.count(F.lit(1)).alias("others"))
    stars = met.join(pairs.where(F.col("others") >= (block or BLOCK)), F.col("b") == F.col("w"), "left")
    stars = stars.select(F.col("b").alias("root"), F.when(F.col("w").isNotNull(), F.col("x")).otherwise(0).alias("sub"), F.col("a").alias("m_key")).distinct()
    stars = saved(stars, "join-stars")
    units = stars.union(stars.select("root", "sub", F.col("root").alias("m_key")).distinct()).withColumn("blocks", F.lit(1))

    # Sets that can't spare all of their common parts meet by those that they keep.
    loose = kept.where((F.col("n") > hot) & (F.shiftright("x", 1) != 0)).select("x", "y", "parts", "size")
    # A part's sets meet at the one with the most common parts: where sets are alike, few and central ones.
    firsts = loose.groupBy(F.col("x").alias("f_x")).agg(F.min(F.struct(-F.col("parts"), F.col("y"))).alias("f")).select("f_x", F.col("f.y").alias("first"))
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rays = loose.join(firsts, (F.col("x") == F.col("f_x")) & (F.pmod(F.xxhash64("y"), F.lit(SALTS)) == F.col("salt"))).where("y <> first").select("first", "y", "size").distinct()
    rays = saved(rays, "join-rays")
    room = F.ceil(F.sum("size") / SHINGLES) if block is None else F.ceil(F.count(F.lit(1)) / block)
    most = F.ceil(F.count(F.lit(1)) / (block or BLOCK))
    sizes = rays.groupBy(F.col("first").alias("s_first")).agg(F.least(room, most).cast("int").alias("blocks"))
    rays = rays.join(sizes, F.col("first") == F.col("s_first")).select("first", F.lit(1).cast("long").alias("sub"), "y", "blocks")
    leads = sizes.select("s_first", F.lit(1).cast("long").alias("sub"), F.col("s_first").alias("y"), "blocks")

    members = units.union(rays).union(leads).join(reps, F.col("m_key") == F.col("key"))
    members = members.select("root", "sub", "key", "rep", "blocks", (F.col("key") == F.col("root")).alias("leader"), F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("own"))
    members = saved(members, "join-members")
    texts = plain.withColumnRenamed("doc_id", "t_id")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 3):
            found = _checked(rows, width)
            if len(found) > 1:
                yield _out(link_block([k for k, *_ in found], [s for _, _, s in found], num, den), ("a", "b"))

    placed = members.hint("merge").join(texts, F.col("rep") == F.col("t_id")).withColumn("block", F.explode(F.when(F.col("leader"), everywhere).otherwise(F.array("own"))))
    placed = placed.select("root", "sub", "block", "key", "leader", "text").repartition(parts, "root", "sub", "block").sortWithinPartitions("root", "sub", "block", "key")
    links = saved(placed.mapInArrow(first_round, "a long, b long").distinct(), "join-links")
    joined = components(links)

    wide = members.where("blocks > 1").select("root", "key", "rep", "blocks", "leader", "own")
    if wide.limit(1).count():
        local = joined.select(F.col("node").alias("l_node"), F.col("root").alias("l_root"))
        held = wide.join(local, F.col("key") == F.col("l_node"), "left").withColumn("part", F.coalesce("l_root", "key")).drop("l_node", "l_root")
        held = saved(held, "join-held")
        main = held.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("root").alias("m_root")).agg(F.max(F.struct("n", "part")).alias("m"))
        main = main.select("m_root", F.col("m.part").alias("m_part"))
        held = held.join(main, F.col("root") == F.col("m_root")).withColumn("apart", F.col("part") != F.col("m_part")).drop("m_root", "m_part")

        def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in _groups(batches, 2):
                found = _checked(rows, width)
                index = [(k, p, s) for k, (p, q), s in found if not q]
                lists, out = Lists([s for _, _, s in index]), []
                for k, (part, query), s in found:
                    if query:
                        near = {index[y][1]: index[y][0] for y in lists.links(s, num, den).tolist() if index[y][1] != part}
                        out += [(k, y) for y in near.values()]
                yield _out(out, ("a", "b"))

        own = held.select("root", F.col("own").alias("block"), "key", "rep", "part", F.lit(False).alias("query"))
        asked = held.where("apart").withColumn("block", F.explode(everywhere)).where("block <> own")
        asked = asked.select("root", "block", "key", "rep", "part", F.lit(True).alias("query"))
        rows = saved(own.union(asked), "join-asked")
        few = "broadcast" if rows.count() <= FEW else "merge"
        rows = rows.hint(few).join(texts, F.col("rep") == F.col("t_id")).select("root", "block", "key", F.struct("part", "query").alias("mark"), "text")
        rows = rows.repartition(parts, "root", "block").sortWithinPartitions("root", "block", "key")
        further = saved(rows.mapInArrow(second_round, "a long, b long").distinct(), "join-links")
        joined = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(further))

    least = joined.join(reps, F.col("node") == F.col("key")).groupBy("root").agg(F.min("rep").alias("least")).withColumnRenamed("root", "l_root")
    merged = joined.join(least, F.col("root") == F.col("l_root")).select(F.col("node").alias("m_key"), "least")
    final = saved(reps.join(merged, F.col("key") == F.col("m_key"), "left").select(F.col("key").alias("f_key"), F.coalesce("least", "rep").alias("component")), "join-final")
    out = all_docs.join(final, F.col("key") == F.col("f_key"), "left")
    found = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id")).alias("component_id"), "mark")
    return found.drop("mark") if mark is None else found


def _checked(rows: list[tuple], width: int) -> list[tuple]:
    """(key, mark, set) of rows (key, mark, text) whose text has that key, each key and mark once."""
    sets = shingle_sets([r[2] for r in rows], width)
    out: dict[tuple, tuple] = {}
    for (key, mark, _), s in zip(rows, sets, strict=True):
        if isinstance(mark, dict):
            mark = (mark["part"], mark["query"])
        if len(s) and set_key(s) == key:
            out[(key, mark)] = (key, mark, s)
    return list(out.values())
