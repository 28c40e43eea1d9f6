"""The pipeline's stages, one by one, and the registered queries on the smallest tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tesserae.llm.common import crc_mod
from tesserae.llm.language import Classifier, dictionaries, training_texts
from tesserae.llm.mixing import mixed
from tesserae.llm.queries import ORACLE_SQL, QUERIES
from tesserae.llm.secrets_scan import RULES

from .helpers import CLASHES, odd_rows, table
from .test_exact import brute_components
from .test_learned import language_rows

SMALL = "/root/testdata/sf0.001"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "source_mixing", "packing"]


def test_near_duplicates_keep_one_of_each_group(spark):
    text = [" ".join(f"g{g}w{k}" for k in range(60)) for g in range(5)]
    rows = [(g * 10 + c, f"{text[g]} end{c % 3}", "en", "s") for g in range(5) for c in range(6)] + [(900, "a lonely text of its own", "en", "s")]
    rows += [(901, "a row twice", "en", "s")] * 2 + [(None, "no id", "en", "s")]
    docs = table(spark, rows)
    out = stage("near_duplicates")(spark, docs, "")
    assert out.columns == docs.columns
    want = {d for d, (_, c) in brute_components([r for r in rows if r[0] is not None], 5, 8, 10).items() if c == d}
    got = sorted((r.doc_id for r in out.collect()), key=str)
    assert got == sorted([*want, None], key=str)


def test_language_stage_keeps_clean_documents(spark):
    docs = table(spark, language_rows() + [(1000, None, None, "s"), (1001, "123", None, "s")])
    out = stage("language_id")(spark, docs, "")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(range(300))


def test_secret_stage_masks_and_keeps_rows(spark):
    rows = [(1, "token=abcdefgh here", "en", "s"), (2, "clean", "en", "s"), *[(d + 20 if d is not None else None, *r) for d, *r in odd_rows()]]
    docs = table(spark, rows)
    out = stage("secret_scan")(spark, docs, "")
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "[REDACTED] here" and got[1].n_chars == 15 and got[2].text == "clean" and got[22].text is None


def test_mixing_stage_draws_rows(spark):
    docs = table(spark, [(k, f"text {k} of some words", "en", f"s{k % 4}") for k in range(200)])
    out = stage("source_mixing")(spark, docs, "")
    assert out.columns == docs.columns and 60 <= out.count() <= 180
    assert out.join(docs, "doc_id").count() == out.count()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    out = __spark_entry__.queries()[name](spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    rows = out.count()
    if name == "op6_exact_top_k":
        assert rows == 5 * spark.read.parquet(f"{SMALL}/embeddings.parquet").where(F.col("vec_id") % 50 == 0).count()
    elif name == "op10_packing":
        assert rows >= n
    else:
        assert rows == n


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    df = QUERIES[name](spark, SMALL)
    cursor = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cursor.fetchall()), key=str)
    assert sorted(map(tuple, df.collect()), key=str) == want


def clashing(docs):
    """docs with further columns named like what stages and operators use inside."""
    return docs.withColumns({c: F.lit("own") for c in (*CLASHES, "k_id", "k_rows", "k_mark", "mark", "further_0", "hit_salt", "w", "f", "place", "doc_tokens")})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_pass_further_columns_through(spark, name):
    rows = [*language_rows(), *[(d + 2000 if d is not None else None, *r) for d, *r in odd_rows()]]
    docs = clashing(table(spark, rows))
    out = stage(name)(spark, docs, "")
    assert out.columns == docs.columns
    plain = stage(name)(spark, table(spark, rows), "")
    want = sorted(plain.collect(), key=str)
    assert sorted(out.select(*plain.columns).collect(), key=str) == want and len(want) > 50
    assert out.where(" and ".join(f"`{c}` = 'own'" for c in docs.columns[5:])).count() == len(want)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_take_empty_tables(spark, name):
    docs = table(spark, [])
    out = stage(name)(spark, docs, "")
    assert out.columns == docs.columns and out.collect() == []


def test_near_duplicates_with_repeated_ids(spark):
    """Of rows with one doc_id but different texts, the one without an earlier copy stays."""
    body = " ".join(f"w{k}" for k in range(40))
    rows = [(1, body, "en", "s"), (5, body, "en", "s"), (5, "another text that stands alone here for once", "en", "s"), (7, body, "en", "s")]
    got = stage("near_duplicates")(spark, table(spark, rows), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, body), (5, rows[2][1])]


def plain_run(spark, docs):
    """The documents that reach packing, stage by stage in plain Python; draws and margins by the operators' rules."""
    usable = F.coalesce(crc_mod(F.col("doc_id"), 5) != 0, F.lit(True))
    classify = Classifier(dictionaries(training_texts(docs, usable))).classify
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if (found := classify(r["text"]))[0] != "und" and found[1] >= 0.01]
    first = brute_components([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows if r["doc_id"] is not None], 5, 8, 10)
    rows = [r for r in rows if first[r["doc_id"]][1] == r["doc_id"]]
    for r in rows:
        spans = sorted({(m.start(), m.end()) for rule in RULES for m in re.finditer(rule.pattern, r["text"], re.A) if not rule.least or len(m.group(rule.group)) >= rule.least})
        out, at = [], 0
        for a, b in spans:
            if a >= at:
                out += [r["text"][at:a], "[REDACTED]"]
            at = max(at, b)
        r["text"] = "".join([*out, r["text"][at:]])
    return rows


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
def test_pipeline_equals_a_plain_version(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r["doc_id"]: r["text"] for r in plain_run(spark, docs)}
    out = corpus_pipeline.run(spark, SMALL).collect()
    got = {r.doc_id: r.doc_tokens for r in out}
    encode = Tokenizer.from_file(public.path("byte_bpe_50k.json")).encode
    assert set(got) <= set(want)  # mixing draws some of them
    drawn = {r.doc_id for r in mixed(spark.createDataFrame([(k, t, *(docs.where(f"doc_id = {k}").select("lang", "source").first())) for k, t in want.items()], "doc_id long, text string, lang string, source string")).where("selected").collect()}
    assert set(got) == drawn and len(drawn) > 20
    for doc_id in sorted(drawn):
        assert got[doc_id] == len(encode(want[doc_id], add_special_tokens=False).ids) + 1
    pieces = sorted((r.doc_id, r.start, r.length) for r in out)
    for (d, s, n), (d2, s2, _) in zip(pieces, pieces[1:], strict=False):
        assert s2 == (s + n if d2 == d else 0)
    assert sum(n for _, _, n in pieces) == sum(got.values())
