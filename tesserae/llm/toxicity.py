"""Toxicity by class-conditional Kneser-Ney models over bytes.

Both classes have a model of a byte after the five before it.  The highest order
counts a class by itself; all lower orders are one distribution of continuation
counts that both classes share, so an expression that is rare in a class backs off
to the same probability in both and says little.  A text's evidence is the difference
of the two log-likelihoods by byte, over the text and over its most telling stretch;
a logistic curve fitted on rows that weren't counted turns it into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

ORDER = 6
DISCOUNT = 0.75
STRETCHES = (192, 24, 8)
TELLING = (7.0, 12.0, 18.0)
SHARD_ROWS = 1 << 21  # grams in a shard of the scoring tables
GROUP_BYTES = 1 << 22  # of text scored at a time, so that shards are opened for more than a batch
FEATURES = 1 + len(STRETCHES) + 2 * len(TELLING)
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.3
_GAP = ORDER - 1
_LUT = np.arange(256, dtype=np.uint8)
_LUT[:33] = 32


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in lower case with blanks before each, and where each begins and ends."""
    raws = [(t or "").strip().lower().encode() for t in texts]
    data = np.frombuffer(b"".join(b" " * _GAP + r for r in raws), np.uint8)
    sizes = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(sizes + _GAP)
    return _LUT[data], ends - sizes, ends


def _grams(data: np.ndarray) -> np.ndarray:
    """The ORDER bytes that end at each place from _GAP on, first byte highest."""
    n = len(data) - _GAP
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for k in range(ORDER):
        out = out << 8 | data[k : k + n]
    return out


def own_grams(texts: list[str | None]) -> np.ndarray:
    """The grams that end within a text, of all texts; none ends in the blanks between two."""
    data, starts, ends = _joined(texts)
    grams = _grams(data)
    edge = np.zeros(len(grams) + 1, np.int64)
    np.add.at(edge, starts - _GAP, 1)
    np.subtract.at(edge, ends - _GAP, 1)
    return grams[np.cumsum(edge[:-1]) > 0]


def count_grams(rows: DataFrame) -> DataFrame:
    """key, toxic_n, plain_n of every gram in rows of text and toxic, over all of them."""
    shape = "key long, toxic_n long, plain_n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [[], [], 0]

        def flush():
            parts = []
            for c in (0, 1):
                if held[c]:
                    key, n = np.unique(np.concatenate(held[c]), return_counts=True)
                    parts.append((key, np.zeros_like(n) if c == 0 else n, n if c == 0 else np.zeros_like(n)))
            held[:] = [[], [], 0]
            key, t, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(t), pa.array(p)], names=["key", "toxic_n", "plain_n"])

        for batch in batches:
            labels = batch.column(1).to_pylist()
            for c in (0, 1):
                grams = own_grams([t for t, x in zip(batch.column(0).to_pylist(), labels, strict=True) if x == c])
                held[c].append(grams)
                held[2] += len(grams)
            if held[2] > 1 << 25:
                yield flush()
        if held[2]:
            yield flush()

    return rows.select("text", "toxic").mapInArrow(run, shape).groupBy("key").agg(F.sum("toxic_n").alias("toxic_n"), F.sum("plain_n").alias("plain_n"))


def _shared(grams: DataFrame) -> DataFrame:
    """key, backoff: the shared lower-order probability of each gram's last byte.

    Order k counts the distinct bytes found before each of its grams; each order is
    interpolated with the next lower one, down to equal probabilities.
    """
    levels, at = {}, grams.select("key")
    for k in range(ORDER - 1, 0, -1):
        at = at.select((F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        at = saved(at, "toxicity-order")
        levels[k] = at
    below: DataFrame | None = None
    for k in range(1, ORDER):
        here = levels[k].withColumn("context", F.shiftrightunsigned("key", 8))
        sums = here.groupBy(F.col("context").alias("s_context")).agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("kinds"))
        rows = here.join(sums, F.col("context") == F.col("s_context"))
        if below is None:
            rows = rows.withColumn("low", F.lit(1 / 256))
        else:
            lower = below.select(F.col("key").alias("l_key"), F.col("p").alias("low"))
            rows = rows.join(lower, F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)) == F.col("l_key"))
        below = rows.select("key", ((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("low")) / F.col("s")).alias("p"))
        below = saved(below, "toxicity-backoff")
    return below


def fit(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, llr, n) for grams and (context, llr, n) for what follows a known context unseen."""
    grams = saved(grams, "toxicity-grams").withColumn("context", F.shiftrightunsigned("key", 8))
    seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
    contexts = saved(grams.groupBy(F.col("context").alias("h")).agg(F.sum("toxic_n").alias("t"), F.sum("plain_n").alias("o"), seen("toxic_n").alias("tk"), seen("plain_n").alias("ok")), "toxicity-contexts")
    rest = lambda n, kinds: F.when(F.col(n) > 0, DISCOUNT * F.col(kinds) / F.col(n)).otherwise(1.0)
    own = lambda c, n: F.when(F.col(n) > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(n)).otherwise(0.0)
    low = _shared(grams).select(F.col("key").alias("low_key"), F.col("p").alias("low"))
    rows = grams.join(contexts, F.col("context") == F.col("h")).join(low, F.col("key").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1)) == F.col("low_key"))
    llr = F.ln(own("toxic_n", "t") + rest("t", "tk") * F.col("low")) - F.ln(own("plain_n", "o") + rest("o", "ok") * F.col("low"))
    return rows.select("key", llr.alias("llr"), (F.col("toxic_n") + F.col("plain_n")).alias("n")), contexts.select(F.col("h").alias("key"), (F.ln(rest("t", "tk")) - F.ln(rest("o", "ok"))).alias("llr"), (F.col("t") + F.col("o")).alias("n"))


def chained(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each slot begins (two slots a key), and all keys and values in the order of their slots."""
    slots = 2 * len(keys) + 1
    slot = keys % slots
    order = np.argsort(slot, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=slots))))
    return starts.astype(np.int32), keys[order], values[order]


def looked_up(table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value of each key, and whether the table has it; keys that share a slot are tried in turn."""
    starts, held, values = table
    slot = keys % (len(starts) - 1)
    at, end = starts[slot], starts[slot + 1]
    out, known = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
    left = np.flatnonzero(at < end)
    while len(left):
        same = held[at[left]] == keys[left]
        hit = left[same]
        out[hit], known[hit] = values[at[hit]], True
        left = left[~same]
        at[left] += 1
        left = left[at[left] < end[left]]
    return out, known


def score_tables(grams: DataFrame, contexts: DataFrame, shard_rows: int = SHARD_ROWS) -> Iterator[tuple]:
    """Shards of the tables of all grams and all contexts, one after another.

    Their number follows the number of grams; a gram lies in the shard of its context.
    """
    grams = saved(grams.select("key", "llr"), "toxicity-model")
    shards = grams.count() // shard_rows | 1  # odd, so that all bytes of a context tell its shard
    parts = [(grams, F.shiftrightunsigned("key", 8)), (contexts.select("key", "llr"), F.col("key"))]
    parts = [x.withColumn("shard", F.pmod(context, F.lit(shards))) for x, context in parts]
    if shards > 1:
        parts = [saved(x.sortWithinPartitions("shard"), "toxicity-shards") for x in parts]
    for k in range(shards):
        own = [x.where(F.col("shard") == k).select("key", "llr").toArrow() for x in parts]
        yield tuple(chained(x.column("key").to_numpy(), x.column("llr").to_numpy().astype(np.float32)) for x in own)


def opened(shard):
    """The tables of a broadcast shard; the worker doesn't hold on to them."""
    path = getattr(shard, "_path", None)
    return shard.load_from_path(path) if path else shard.value


def features(texts: list[str | None], tables, opened=lambda x: x) -> np.ndarray:
    """For each text the mean evidence of a byte, over the whole text and over its most
    telling stretches, and how much of it lies in short stretches of strong evidence.

    tables: the shards; they are opened in turn."""
    out = np.zeros((len(texts), FEATURES))
    data, starts, ends = _joined(texts)
    grams = _grams(data)
    if not len(grams):
        return out
    evidence = np.empty(len(grams), np.float32)
    for shard, x in enumerate(tables):
        seen, after = opened(x)
        for at in range(0, len(grams), 1 << 20):
            g = grams[at : at + (1 << 20)]
            own = slice(None) if len(tables) == 1 else np.flatnonzero((g >> 8) % len(tables) == shard)
            g = g[own]
            value, known = looked_up(seen, g)
            other = np.flatnonzero(~known)
            value[other] = looked_up(after, g[other] >> 8)[0]
            evidence[at : at + (1 << 20)][own] = value
    total = np.concatenate(([0.0], np.cumsum(evidence, dtype=np.float64)))
    for k, (a, b) in enumerate(zip(starts - _GAP, ends - _GAP, strict=True)):
        if b > a:
            out[k, 0] = (total[b] - total[a]) / (b - a)
            for j, stretch in enumerate(STRETCHES):
                wide = min(stretch, b - a)
                sums = total[a + wide : b + 1] - total[a : b + 1 - wide]
                out[k, j + 1] = sums.max() / stretch
            for j, least in enumerate(TELLING):
                strong = np.count_nonzero(sums > least)
                out[k, 1 + len(STRETCHES) + 2 * j :][:2] = np.log1p(strong), np.sqrt(strong / (b - a))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and spread of the columns, and the weights (constant last) of a fitted logistic curve."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(len(w)) / 100, z.T @ (p - y) + ridge * len(x) / 100 * w)
        w -= np.clip(step, -2, 2)
    return mean, spread, w


def toxicity(docs: DataFrame, labels: DataFrame, counted: Column, calibrated: Column, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """doc_id, score and predicted of every document.

    docs: doc_id and text; labels: doc_id and toxic (0 or 1; others and nulls are
    ignored; of several labels of one doc_id the highest holds).  Grams are counted over all labelled documents where `counted` holds; the
    curve is fitted on at most about calibration_rows labelled documents where
    `calibrated` holds, chosen by a hash.  Counting is a sum by gram, so no class or
    source meets in one task.  All grams and contexts are scored by: their tables are
    broadcast in shards, as many as the grams ask for, and a worker holds one at a time.
    A score reads text alone; null, empty and blank texts carry no evidence and get the
    curve's value there.  A text may be as long as a row can be; a score on the threshold is
    predicted 1.  Without rows of both classes every score is 0.  Repeated rows get
    equal scores; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.where(calibrated).count()
    known = known.select(F.col("doc_id").alias("l_id"), "toxic")
    share = min(1.0, calibration_rows / max(n, 1))
    drawn = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    used = docs.select("doc_id", "text").where(counted | (calibrated & drawn))
    rows = saved(used.join(known.hint("merge"), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic", counted.alias("counted")), "toxicity-rows")
    grams, contexts = fit(count_grams(rows.where("counted")))
    model = [spark.sparkContext.broadcast(x) for x in score_tables(grams, contexts)]
    use = opened if len(model) > 1 else lambda x: x.value

    def measured(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        def flush():
            f, at = features([t for x in held for t in x.column(column).to_pylist()], model, use), 0
            for x in held:
                yield x, f[at : at + len(x)]
                at += len(x)
            held.clear()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.nbytes for x in held) > GROUP_BYTES:
                yield from flush()
        yield from flush()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, f in measured(batches, 0):
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, f.T.copy())], names=["toxic", *names])

    names = [f"f{k}" for k in range(FEATURES)]
    seen = rows.where(~F.col("counted")).select("text", "toxic").mapInArrow(measure, ", ".join(["toxic int", *(f"{x} double" for x in names)])).toArrow()
    y = seen.column("toxic").to_numpy().astype(float)
    x = np.column_stack([seen.column(c).to_numpy() for c in names])
    curve = logistic(x, y) if len(y) and 0 < y.sum() < len(y) else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, f in measured(batches, 1):
            s = np.zeros(len(f))
            if curve is not None:
                mean, spread, w = curve
                s = 1 / (1 + np.exp(-np.clip(((f - mean) / spread) @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int")
