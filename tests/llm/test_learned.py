"""Operators that learn: held-out accuracy, and defined results for odd input."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.llm.common import crc_mod
from tesserae.llm.language import Classifier, dictionaries, identify, letters, training_texts
from tesserae.llm.toxicity import _grams, _joined, count_grams, features, fit, score_tables, toxicity

from .helpers import odd_rows, table

SYLLABLES = {"aa": "ka to mi ra lu".split(), "bb": "schn ert ung ver zei".split(), "cc": "oix eau que tre lle".split()}


def made(lang, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def language_rows():
    return [(k, made(lang, 5 + k % 60, k), lang, "s") for k in range(300) for lang in [list(SYLLABLES)[k % 3]]]


def test_language_held_out(spark):
    docs = table(spark, language_rows())
    held = crc_mod(F.col("doc_id"), 5) == 0
    out = identify(docs, ~held).where(held).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 and r.accepted for r in out)


@pytest.mark.parametrize("clashes", [False, True])
def test_language_odd_rows(spark, clashes):
    docs = table(spark, language_rows() + [(d + 1000 if d is not None else None, t, None, s) for d, t, _, s in odd_rows()], clashes)
    out = {}
    for r in identify(docs, F.lit(True)).where("lang is null").collect():
        out.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, out.values())) == len(odd_rows())
    for d in (1002, 1003, 1004, 1008):
        assert out[d][0].lang_pred == "und" and out[d][0].score == 0 and not out[d][0].accepted
    assert out[1001][0].lang_pred in SYLLABLES and out[1007][0] == out[1007][1]
    assert identify(table(spark, []), F.lit(True)).collect() == []
    alone = identify(table(spark, odd_rows()), F.lit(False)).collect()  # nothing to learn from
    assert {r.lang_pred for r in alone} == {"und"}


def test_language_ties_are_rejected():
    c = Classifier(dictionaries({"x": ["abc def"], "y": ["abc def"]}))
    assert c.classify("abc def ghi") == ("x", 0.0)


def toxic_rows():
    r = random.Random(2)
    rows, labels = [], []
    for k in range(900):
        w = made("aa", r.randint(10, 80), k).split()
        bad = k % 6 == 0
        for _ in range(1 + len(w) // 25 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["grobnik", "vexlor", "grobnaz"]))
        rows.append((k, " ".join(w), "aa", "s"))
        labels.append((k, 1, int(bad)))
    return rows, labels


@pytest.mark.parametrize("clashes", [False, True])
def test_toxicity_held_out(spark, clashes):
    rows, labels = toxic_rows()
    docs = table(spark, rows + [(d + 5000 if d is not None else None, t, lang, s) for d, t, lang, s in odd_rows()], clashes)
    marks = spark.createDataFrame(labels + [(1, 1, None), (2, 1, 7)], "doc_id long, quality int, toxic int")
    fold = F.coalesce(crc_mod(F.col("doc_id"), 4), F.lit(0))
    got = toxicity(docs, marks, fold.isin(0, 1), fold == 3).withColumn("held", fold == 2).collect()
    assert len(got) == len(rows) + len(odd_rows())
    known = {k: t for k, _, t in labels}
    held = [(r.predicted, known[r.doc_id]) for r in got if r.held and r.doc_id in known]
    caught = [p for p, t in held if t]
    assert sum(caught) >= 0.9 * len(caught)
    assert sum(p for p, t in held if not t) <= 0.05 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    blank = {r.score for r in got if r.doc_id in (5002, 5003, 5004)}
    assert len(blank) == 1
    seven = [r.score for r in got if r.doc_id == 5007]
    assert len(seven) == 2 and seven[0] == seven[1]


def test_toxicity_without_labels(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table(spark, odd_rows())
    assert {r.score for r in toxicity(docs, marks, F.lit(True), F.lit(False)).collect()} == {0.0}
    assert toxicity(table(spark, []), marks, F.lit(True), F.lit(False)).collect() == []


@pytest.mark.parametrize("shard_rows", [1 << 21, 40])
def test_toxicity_scores_by_every_gram(spark, shard_rows):
    number, slots = (lambda t: int.from_bytes(t.encode(), "big")), 2_097_143
    step = slots * -(-number("aaaaaa") // slots) + number("grobni") % slots
    twin = next(t for t in (k.to_bytes(6, "big") for k in range(step, number("zzzzzz"), slots)) if t.isalpha() and t.islower()).decode()
    assert number(twin) % slots == number("grobni") % slots  # one slot in a table of that size
    rows = [("grobnik vexlor grobnik", 1), *[(f"{made('aa', 20, k)} {twin}", 0) for k in range(30)]]
    grams, contexts = fit(count_grams(spark.createDataFrame(rows, "text string, toxic int")))
    seen, after = ({r.key: r.llr for r in x.collect()} for x in (grams, contexts))
    tables = list(score_tables(grams, contexts, shard_rows))
    assert (len(tables) > 1) == (len(seen) >= 2 * shard_rows)
    texts = [rows[0][0], rows[1][0], f"{twin} grobnik", "grobnax", "0", "", None]
    got = features(texts, tables)[:, 0]
    for t, x in zip(texts, got, strict=True):
        own = [seen.get(g, after.get(g >> 8, 0.0)) for g in _grams(_joined([t])[0]).tolist()]
        assert x == pytest.approx(sum(own) / max(len(own), 1), abs=1e-4)


def kneser_ney(rows, text):
    """Mean log-likelihood difference a byte of text, straight from the counts of its grams."""
    import math
    from collections import Counter

    counts = [Counter(), Counter()]
    for t, c in rows:
        counts[c].update(_grams(_joined([t])[0]).tolist())
    every = set(counts[0]) | set(counts[1])
    levels, at = {}, every
    for k in range(5, 0, -1):
        c = Counter(g & ((1 << 8 * k) - 1) for g in at)
        levels[k], at = c, set(c)

    def shared(g, k):
        if k == 0:
            return 1 / 256
        key, low = g & ((1 << 8 * k) - 1), shared(g, k - 1)
        same = [n for other, n in levels[k].items() if other >> 8 == key >> 8]
        return (max(levels[k].get(key, 0) - 0.75, 0) + 0.75 * len(same) * low) / sum(same)

    def p(g, c):
        same = [n for other, n in counts[c].items() if other >> 8 == g >> 8]
        if not same:
            return shared(g, 5)
        return max(counts[c].get(g, 0) - 0.75, 0) / sum(same) + 0.75 * len(same) / sum(same) * shared(g, 5)

    grams = [g for g in _grams(_joined([text])[0]).tolist()]
    return sum(math.log(p(g, 1)) - math.log(p(g, 0)) for g in grams if g in every) / len(grams), all(g in every for g in grams)


def test_toxicity_models_by_brute_force(spark):
    rows = [("grob grob ver", 1), ("grob nix ver", 1), ("lala nix ver la", 0), ("lala lulu ver grob", 0), ("lulu nix", 0)]
    grams, contexts = fit(count_grams(spark.createDataFrame(rows, "text string, toxic int")))
    tables = list(score_tables(grams, contexts))
    for text in ("grob grob ver", "lala nix ver la", "lulu nix", "grob nix ver"):
        want, known = kneser_ney(rows, text)
        assert known and features([text], tables)[0, 0] == pytest.approx(want, abs=1e-4)


def test_toxicity_takes_one_label_a_document(spark):
    rows, labels = toxic_rows()
    docs = table(spark, rows)
    fold = F.coalesce(crc_mod(F.col("doc_id"), 4), F.lit(0))
    shape = "doc_id long, quality int, toxic int"
    once = toxicity(docs, spark.createDataFrame(labels, shape), fold.isin(0, 1), fold == 3)
    more = labels + labels + [(d, q, 0) for d, q, t in labels if t]  # repeated, and contradicted
    again = toxicity(docs, spark.createDataFrame(more, shape), fold.isin(0, 1), fold == 3)
    want = {r.doc_id: r.score for r in once.collect()}
    assert {r.doc_id: pytest.approx(r.score, abs=1e-9) for r in again.collect()} == want


def test_language_equals_plain_compression(spark):
    """The same dictionaries and sizes, with one compressor call a block and no shared state."""
    import zstandard

    docs = table(spark, language_rows())
    usable = F.col("doc_id") % 3 != 0
    raw = dictionaries(training_texts(docs, usable))

    def size(text, lang, level):
        d = zstandard.ZstdCompressionDict(raw[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data = letters(text)
        make = lambda: zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(make().compress(data[k : k + 1024])) for k in range(0, len(data), 1024))

    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, usable).collect()}
    for d, t, *_ in language_rows()[::10]:
        for level in (3, 19):
            sizes = sorted((size(t, x, level), x) for x in raw)
            margin = 1 - sizes[0][0] / sizes[1][0]
            if margin >= 0.03:
                break
        assert got[d] == (sizes[0][1], pytest.approx(margin, abs=0.02))


def test_language_dictionaries_for_every_language(spark):
    rows = [(k, f"wort{k} satz{k % 7} text", f"l{k % 70}", "s") for k in range(210)] + [(5, "wort5 satz5 text", "l5", "s")] * 50
    texts = training_texts(table(spark, rows), F.lit(True), sample_texts=140)
    assert len(texts) == 70 and all(1 <= len(x) <= 2 for x in texts.values())
    assert len(training_texts(table(spark, rows), F.lit(True), sample_texts=7)) == 70
