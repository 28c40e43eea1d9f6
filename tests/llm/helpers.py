"""Small tables and brute-force versions for the tests of the corpus operators."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as further columns of their input.
CLASHES = ("row", "key", "blob", "spans", "tokens", "u", "x", "y", "host", "line", "family", "probability", "selected", "score", "lang_pred", "accepted", "curve_key", "tie", "words", "root", "node", "c_source", "toxic", "first_id")


def table(spark, rows, clashes=False):
    full = [(d, t, l, s, None if t is None else len(t)) for d, t, l, s in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.withColumns({c: F.lit("other") for c in CLASHES}) if clashes else df


def words(n, seed, size=4):
    r = random.Random(seed)
    return [r.choice("abcdefghij"[:size]) * r.randint(1, 2) for _ in range(n)]


def odd_rows():
    """Nulls, empty, blank, very long, repeated and tied rows."""
    long = " ".join(words(30_000, 1, 10))
    return [
        (1, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, "b"),
        (4, " \n\t ", "fr", None),
        (None, "a text without an id stands here among the others today", "en", "a"),
        (5, long, "en", "a"),
        (6, "the quick brown fox jumps over the lazy dog and runs away from it", "en", None),
        (7, "naïve café 　 text\x0b with\x0c odd\r\nblanks 😀 and $$$ | # signs", "fr", "b"),
        (7, "naïve café 　 text\x0b with\x0c odd\r\nblanks 😀 and $$$ | # signs", "fr", "b"),
        (8, "12345 67890", "de", "a"),
        (-9, "one", "en", "a"),
    ]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
