"""The queries over the operators of this subpackage, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    fold = F.coalesce(crc_mod(F.col("doc_id"), 4), F.lit(0))
    docs, labels = (table(spark, sf_dir, x) for x in ("documents", "labels"))
    return toxicity(docs, labels, fold.isin(0, 1), fold == 3).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), _tokenizer()))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "c_source", "c_lang", "c_topic", "tokens", "probability", "selected")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets_scan import digest, findings, scan_increments

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    night = F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0))
    return digest(findings(docs, scan_increments(docs, [night == 0, night == 1])))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_along_curve

    return pack_along_curve(table(spark, sf_dir, "documents"), _tokenizer())


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_language_id, op4_token_store, op5_substring_dedup, op6_exact_top_k, op7_ngram_join, op8_mixing, op9_secret_scan, op10_packing)}

def _secret_sql() -> str:
    from .secrets_scan import BASE, RULES

    rows = ", ".join(f"({k}, '{r.kind}', '{r.pattern.replace(chr(39), chr(39) * 2)}', {r.least}, {r.group})" for k, r in enumerate(RULES))
    span = "kind || ':' || st || ':' || (st + n)"
    base = "kind IN (" + ", ".join(f"'{k}'" for k in BASE) + ")"
    length = "lambda p: length(p)"
    return f"""
WITH r(kind_no, kind, re, least, grp) AS (VALUES {rows}),
s AS (SELECT doc_id, kind_no, kind, re, least, regexp_extract_all(t, re) AS ms, string_split_regex(t, re) AS ps FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), r),
e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM s),
f AS (SELECT doc_id, kind_no, kind, (coalesce(list_sum(list_transform(ps[1:i], {length})), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], {length})), 0))::BIGINT AS st, length(ms[i]) AS n
  FROM e WHERE least = 0 OR length(regexp_extract(ms[i], re, 2)) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
  string_agg({span}, ',' ORDER BY st, kind_no) FILTER ({base}) AS b, string_agg({span}, ',' ORDER BY st, kind_no) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)"""


_WORD = r"[^\x20\x09-\x0D]+"
_EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
g AS (SELECT r, k, array_to_string(ws[k:k + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS k FROM w)),
again AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT k + j) AS n FROM g JOIN again USING (r, g), range(5) x(j) GROUP BY r),
l AS (SELECT r, host, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS nth FROM d),
m AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(line, '{_EDGE}', '', 'g')), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS plain,
  len(regexp_extract_all(line, '{_WORD}')) AS words FROM l WHERE regexp_matches(line, '{_WORD}')),
f AS (SELECT r, string_agg(plain, chr(10) ORDER BY nth) AS family, count(*) - count(DISTINCT line) AS dups FROM m GROUP BY r),
h AS (SELECT host, greatest(50, count(DISTINCT family) * 0.005) AS most FROM m JOIN f USING (r) GROUP BY host),
c AS (SELECT m.host AS host, plain FROM m JOIN f USING (r) JOIN h ON m.host IS NOT DISTINCT FROM h.host GROUP BY m.host, plain, most HAVING count(DISTINCT family) > most),
gone AS (SELECT r, sum(words) AS words, count(*) AS n FROM m JOIN c ON m.plain = c.plain AND m.host IS NOT DISTINCT FROM c.host GROUP BY r),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.words, 0)::BIGINT AS words_removed, coalesce(gone.n, 0)::BIGINT AS lines_removed
  FROM d JOIN w USING (r) LEFT JOIN f USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - words_removed >= 10 AND n_words - words_removed >= 0.5 * n_words AS kept FROM b""",
    "op9_secret_scan": _secret_sql(),
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM w),
p AS (SELECT doc_id, k, md5(array_to_string(ws[k:k + 12], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM w)),
m AS (SELECT g, min(doc_id) AS least FROM p GROUP BY g),
gone AS (SELECT DISTINCT doc_id, k + j AS k FROM (SELECT p.doc_id, p.k FROM p JOIN m USING (g) WHERE least < doc_id), range(13) t(j)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS left_n FROM x ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(left_n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op6_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}
