"""Language identification by compression against one dictionary for each language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

SAMPLE_DOCS = 128
SAMPLE_CHARS = 2000
SAMPLE_TEXTS = 51_200  # of all languages together
BLOCK = 1024
MARGIN = 0.01
LEVEL, CLOSE_LEVEL = 3, 19
CLOSE = 0.03
UNKNOWN = "und"


def training_texts(docs: DataFrame, usable: Column, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, sample_texts: int = SAMPLE_TEXTS) -> dict[str, list[str]]:
    """A bounded sample of labelled texts for every language.

    At most sample_docs different texts of at most sample_chars characters a language,
    those with the smallest hashes of doc_id and text.  Where that makes more than
    sample_texts in all, each language gets an equal share of them, one at least, so no
    language goes without a dictionary.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike("\\p{L}"))
    n = rows.agg(F.count_distinct("lang")).first()[0]
    if not n:
        return {}
    sample_docs = max(1, min(sample_docs, sample_texts // n))
    rows = rows.withColumn("spot", F.xxhash64("doc_id", "text"))
    # Repeated rows have one spot; a task sends on no more than its own first spots of each language.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("spot"))
    spots = rows.select("lang", "spot").distinct().withColumn("place", place).where(F.col("place") <= sample_docs)
    last = {r["lang"]: r["last"] for r in spots.groupBy("lang").agg(F.max("spot").alias("last")).collect()}
    limit = F.create_map(*(F.lit(x) for kv in last.items() for x in kv))
    near = rows.where(F.col("spot") <= limit[F.col("lang")])
    first = near.groupBy("lang", "spot").agg(F.min(F.substring("text", 1, sample_chars)).alias("text"))
    found: dict[str, list[tuple]] = {}
    for r in first.select("lang", "spot", "text").collect():
        found.setdefault(r["lang"], []).append((r["spot"], r["text"]))
    return {lang: [t for _, t in sorted(rows)] for lang, rows in sorted(found.items())}


_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The text's letters in lower case, with one space for anything else between them."""
    return (" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode()


def dictionaries(samples: dict[str, list[str]]) -> dict[str, bytes]:
    return {lang: b"".join(map(letters, texts)) for lang, texts in samples.items()}


class Classifier:
    """Sizes of a text under every dictionary, in independently compressed blocks.

    Texts whose two smallest sizes are close at the fast level are compressed anew at
    the thorough one, whole.
    """

    def __init__(self, raw: dict[str, bytes]):
        self.langs = sorted(raw)
        self.fast = [_compressor(raw[lang], LEVEL) for lang in self.langs]
        self.thorough = [_compressor(raw[lang], CLOSE_LEVEL) for lang in self.langs]

    def classify(self, text: str | None) -> tuple[str, float]:
        """The language of the smallest encoding and its margin, 1 - smallest / second."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        raw = letters(text)
        blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
        found = self._smallest(blocks, self.fast)
        return found if found[1] >= CLOSE else self._smallest(blocks, self.thorough)

    def _smallest(self, blocks: list[bytes], compress: list) -> tuple[str, float]:
        sizes = [sum(map(len, map(c, blocks))) for c in compress]
        first = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sizes[:first] + sizes[first + 1 :]
        return self.langs[first], 1.0 - sizes[first] / min(rest) if rest else 1.0


def _compressor(raw: bytes, level: int):
    import zstandard

    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress


_made: dict[int, tuple[dict, Classifier]] = {}


def identify(docs: DataFrame, usable: Column, margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score and accepted.

    Learns from text and lang of rows where `usable` holds; a prediction reads text
    alone.  A text that is null or has no letter is `und` with score 0 and not
    accepted.  score is 1 - smallest / second smallest size over all blocks of the
    whole text; accepted means score >= margin, so ties and narrow margins are
    rejected (the smallest language name is predicted on a tie).  Without labelled
    rows everything is `und`.  Repeated rows get equal results, an empty table gives
    none.  Columns named like the new ones are replaced.
    """
    small_batches(docs.sparkSession)
    raw = dictionaries(training_texts(docs, usable))
    key = hash(tuple(sorted((k, hash(v)) for k, v in raw.items())))
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    at = kept.index("text")
    shape = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _made:
            _made.clear()
            _made[key] = (shared.value, Classifier(shared.value))
        classify = _made[key][1].classify
        for batch in batches:
            found = [classify(t) for t in batch.column(at).to_pylist()]
            lang, score = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            accepted = pa.array([f[0] != UNKNOWN and f[1] >= margin for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, score, accepted], names=shape.names)

    return docs.select(*kept).mapInArrow(run, shape)
