"""Operators whose results a brute-force version can give."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import common, ngram_join
from tesserae.llm import hashing as H
from tesserae.llm.components import components
from tesserae.llm.fm_index import FMIndex
from tesserae.llm.mixing import mixed, raked, residuals
from tesserae.llm.ngram_join import Lists, _meetings, jaccard_components, signatures
from tesserae.llm.packing import hilbert_index, pack_along_curve
from tesserae.llm.quality import quality_rules, repeated_words, text_counts
from tesserae.llm.secrets_scan import digest, findings, redacted, scan, scan_increments, spans_text
from tesserae.llm.substring_dedup import substring_dedup
from tesserae.llm.token_store import TokenFile, pack, read_token_files, write_token_files
from tesserae.llm.tokens import Encoder, encoder
from tesserae.llm.topk import BitSlicedIndex, exact_top_k

from .helpers import SCHEMA, odd_rows, rows_of, table, words

BLANK = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_word_hashes_depend_on_the_word_alone():
    h, at = H.words([b"one two", None, b"", b" two  ONE\x0bone ", b"TWO"])
    assert at.tolist() == [0, 2, 2, 2, 5, 6]
    assert h[1] == h[2] and h[0] == h[4] and len(set(h.tolist())) == 4
    low, _ = H.words([b"one two", None, b"", b" two  ONE\x0bone ", b"TWO"], lower=True)
    assert low[3] == low[0] and low[5] == low[1]


def test_encoder_equals_the_library(tokenizer):
    e = Encoder(tokenizer)
    r = random.Random(3)
    odd = ["", " ", "a  b", " a", "a ", "a \n b", "a\n\nb c", "x <|endoftext|> y", "it's 'll go", "a　b 　 c", "\t a", "foo.\n bar", "12 34  5", "😀 😀😀 ok", "a\nb", "\n", "a\n", "ab.cd, x!!"]
    odd += ["".join(r.choice([" ", "\n", "a", "é", "1", ".", "'", "s", "\t", " "]) for _ in range(r.randint(1, 40))) for _ in range(400)]
    for _ in range(2):  # again with a filled cache
        got = e.encode(odd)
        for text, ids in zip(odd, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert e.encode([None]) == [b""]


def test_token_file_random_access():
    r = np.random.default_rng(1)
    ids = r.integers(0, 1 << 17, 5000)
    ids[::7] = r.integers(0, 256, len(ids[::7]))
    f = TokenFile(pack(ids, [5, None, -7], [1, 4000, 999]))
    assert f.doc_ids == [5, None, -7] and f.n_tokens == 5000
    assert [f.token(i) for i in range(0, 5000, 13)] == ids[::13].tolist()
    assert f.document(1).tolist() == ids[1:4001].tolist()
    assert f.tokens(4999, 5000).tolist() == ids[4999:].tolist() and f.tokens(7, 7).tolist() == []
    empty = TokenFile(pack(np.zeros(0, np.uint32), [], []))
    assert empty.doc_ids == [] and empty.n_tokens == 0


@pytest.mark.parametrize("clashes", [False, True])
def test_token_store(spark, tokenizer, clashes):
    rows = odd_rows()
    got = rows_of(read_token_files(write_token_files(table(spark, rows, clashes), tokenizer, file_tokens=100)))
    at, want = 0, []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.frombuffer(encoder(tokenizer).encode([t])[0], "<u4").tolist() + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want, key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert rows_of(read_token_files(write_token_files(table(spark, []), tokenizer))) == []


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        key = hilbert_index(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        along = grid[np.argsort(key)]
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("clashes", [False, True])
def test_packing_round_trip(spark, tokenizer, clashes):
    rows = odd_rows()
    got = [r.asDict() for r in pack_along_curve(table(spark, rows, clashes), tokenizer, length=64).collect()]
    by_sequence = {}
    for p in got:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 64 or at < 64 and at & (at - 1) == 0
    want = Counter()
    for d, t, *_ in rows:
        ids = np.frombuffer(encoder(tokenizer).encode([t])[0], "<u4").tolist() + [0]
        want[d, len(ids)] += len(ids)
        if [r[0] for r in rows].count(d) == 1:
            pieces = sorted((p for p in got if p["doc_id"] == d), key=lambda p: p["start"])
            at = 0
            for p in pieces:
                assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
                at += p["length"]
            assert at == len(ids)
    have = Counter()
    for p in got:
        have[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert have == want
    assert pack_along_curve(table(spark, []), tokenizer).collect() == []


def test_text_counts():
    assert text_counts(None) == text_counts("") == (0, 0, 0, 0, 0)
    assert text_counts("é b\nc\nc\n \n \nc") == (5, 5, 0, 2, 0)
    for seed in range(30):
        w = [x.encode() for x in words(40, seed, 2)]
        grams = [tuple(w[k : k + 5]) for k in range(36)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        assert repeated_words(w) == len(covered)


@pytest.mark.parametrize("clashes", [False, True])
def test_quality_rules(spark, clashes):
    common = "this line stands in very many documents of the host 12"
    own = lambda k: " ".join(words(30, k, 10))
    rows = [(1000 + k, f"{common}\n{own(k)}", "en", "h") for k in range(60)]
    rows += [(1100 + k, f"{common.replace('12', '77')}\nfew own words {chr(97 + k)} here today", "en", "h") for k in range(5)]
    rows += [(1200 + k, own(999), "en", "h") for k in range(80)]  # copies count once
    rows += [(1300, f"{common}\n{own(300)}", "en", "other"), *odd_rows()]
    got = {}
    for r in quality_rules(table(spark, rows, clashes), min_documents=50, host_share=0.0).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    n = len(common.split())
    assert all(got[1000 + k][0].kept and got[1000 + k][0].words_removed == n for k in range(60))
    assert not any(got[1100 + k][0].kept or got[1100 + k][0].base_failed for k in range(5))
    assert all(got[1200 + k][0].kept and got[1200 + k][0].words_removed == 0 for k in range(80))
    assert got[1300][0].words_removed == 0
    for d, t, *_ in odd_rows():
        r = got[d][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == text_counts(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert len(got[7]) == 2 and got[7][0] == got[7][1]
    assert quality_rules(table(spark, [])).collect() == []


def test_quality_counts_unlike_documents_that_share_a_block(spark):
    block = [f"clause {chr(97 + k)} of a licence that stands below very many texts" for k in range(20)]
    own = lambda k: "\n".join(" ".join(words(150, seed, 10)) for seed in (2 * k, 2 * k + 1))
    rows = [(k, own(k) + "\n" + "\n".join(block), "en", "h") for k in range(300)]
    rows += [(1000 + k, own(999) + "\n" + "\n".join(f"copied {x}" for x in block), "en", "h") for k in range(80)]
    got = {r.doc_id: r for r in quality_rules(table(spark, rows)).collect()}
    assert {got[k].lines_removed for k in range(300)} == {20}
    assert {got[k].words_removed for k in range(300)} == {sum(len(x.split()) for x in block)}
    assert {got[1000 + k].lines_removed for k in range(80)} == {0}  # copies of one text count once


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(t):
    t = t or ""
    s = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(s)


@pytest.mark.parametrize("clashes", [False, True])
def test_secret_scan(spark, clashes):
    r = random.Random(5)
    bits = ["password", "Secret", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdef", "x1", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef" * 2, "é", "😀", "\n", "--", "secret:token: abcdefgh"]
    rows = [(k, "".join(r.choice(bits) for _ in range(r.randint(1, 30))), "en", "a") for k in range(300)] + odd_rows()
    docs = table(spark, rows, clashes)
    ledger = scan(docs)
    found = findings(docs, ledger)
    got = {}
    for x in digest(found).collect():
        got.setdefault(x.doc_id, []).append(x)
    for d, t, *_ in rows:
        if d is None:
            continue
        s = brute_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        for x in got[d][:1]:
            kinds = Counter(k for *_, k in s)
            if [q[0] for q in rows].count(d) == 1:
                assert (x.n_assign, x.n_access, x.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"]), repr(t)
                assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sum(map(len, got.values())) == len(rows)
    assert scan(table(spark, [])).collect() == []


def test_secret_ledger_scans_only_what_is_new(spark):
    old = table(spark, [(1, "token=abcdefgh", "en", "a"), (2, "token=abcdefgh", "en", "a")])
    ledger = scan(old)
    assert ledger.count() == 1
    forged = ledger.withColumn("spans", F.filter("spans", lambda x: F.lit(False)))
    new = scan(old.union(table(spark, [(3, "secret=12345678", "en", "a")])), forged)
    assert {r.n_assign for r in digest(findings(old, new)).collect()} == {0}  # taken from the ledger
    assert new.count() == 2
    again = scan(old, forged, version=2)
    assert [r.n_assign for r in digest(findings(old, again, version=2)).collect()] == [1, 1]


def test_redaction_masks_overlapping_spans_once(spark):
    text = "é token=" + "0123456789abcdef" * 2 + " end"
    docs = table(spark, [(1, text, "en", "a"), (2, "clean", "en", "a")])
    out = findings(docs, scan(docs)).select("doc_id", redacted(F.col("text"), F.col("spans")).alias("t"), spans_text(F.col("spans")).alias("s")).collect()
    assert {r.doc_id: r.t for r in out} == {1: "é [REDACTED] end", 2: "clean"}
    assert {r.doc_id: r.s for r in out}[1] == "assign:2:40,hex:8:40"


def test_bit_slices_give_exact_scores():
    r = np.random.default_rng(2)
    for n, dims in ((1, 1), (70, 9), (300, 64)):
        x, q = r.integers(-256, 256, (n, dims)), r.integers(-256, 256, dims)
        slices = BitSlicedIndex(x).scores(q)
        bits = np.array([np.unpackbits(s.view(np.uint8), bitorder="little")[:n] for s in slices]).astype(np.int64)
        value = sum(b << k for k, b in enumerate(bits[:-1])) - (bits[-1] << (len(bits) - 1))
        assert value.tolist() == (x @ q).tolist()


@pytest.mark.parametrize("rows,queries", [(16_384, 1_024), (20, 3)])
def test_exact_top_k(spark, rows, queries):
    r = np.random.default_rng(4)
    data = [(k, [float(v) for v in r.integers(-4, 5, 6) / 256], None) for k in range(120)]  # many ties
    data += [(120, None, None), (121, [None] * 6, None), (150, [float("nan")] * 6, None), (151, [float("inf")] * 6, None), (None, [1.0] * 6, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(0) for c in ("v", "rb", "qb", "q", "score", "rank")})
    got = sorted(tuple(x) for x in exact_top_k(df, F.col("vec_id") % 50 == 0, rows=rows, queries=queries).collect())
    x = np.array([v for k, v, _ in data[:120]])
    x = np.floor(256 * x).astype(int)
    want = []
    for q in (0, 50, 100):
        order = [j for j in np.lexsort((np.arange(120), -(x @ x[q]))) if j != q][:5]
        want += [(q, k + 1, int(j), int(x[j] @ x[q])) for k, j in enumerate(order)]
    assert got == sorted(want)
    assert exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    one = exact_top_k(df.where("vec_id in (0, 7)"), F.col("vec_id") % 50 == 0).collect()
    assert len(one) == 1 and one[0].vec_id == 7


def test_components(spark):
    r = random.Random(8)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    pairs += [(9000, k) for k in range(7000, 8500)] + [(k, k + 3000) for k in range(7000, 7300)]  # a hub, and chains from it
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in pairs if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len(want) and {x.node: x.root for x in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def jaccard(a, b):
    return len(a & b), len(a | b)


def brute_components(rows, width, num, den):
    sets, parent = {}, {}
    for d, t, *_ in rows:
        w = BLANK.findall((t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
        sets[d] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] * bool(w))
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            inter, union = jaccard(sets[a], sets[b])
            if sets[a] and sets[b] and den * inter >= num * union:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def edited(base, n, seed):
    r = random.Random(seed)
    w = list(base)
    for _ in range(n):
        w[r.randrange(len(w))] = f"z{r.randrange(1000)}"
    return " ".join(w)


def near_rows():
    rows, at = [], 0
    for g, size in enumerate((3, 8, 40, 90, 200)):
        base = [f"w{g}_{k}" for k in range(size)]
        for k in range(14):
            rows.append((at, edited(base, k % 5, at), "en", "a"))
            at += 1
    for k in range(40):
        rows.append((at + k, " ".join(words(k % 9, k, 2)), "en", "a"))
    return rows


@pytest.mark.parametrize("width,num,den,block,hot", [(3, 9, 10, 200, 60), (5, 8, 10, 200, 60), (3, 9, 10, 4, 60), (5, 8, 10, 3, 60), (3, 9, 10, 4, 2), (5, 8, 10, 3, 2), (5, 8, 10, 200, 1)])
def test_jaccard_components(spark, width, num, den, block, hot):
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(table(spark, rows), width, num, den, block, hot).collect()}
    assert got == brute_components(rows, width, num, den)


def common_line_rows(n=1500, copies=40):
    """Unlike sets that share one line, most of it in the short ones; a chain of near copies; a large group."""
    line = " ".join(f"common{k}" for k in range(14))
    rows = [(k, " ".join(words(6 + k % 60, k, 10)) + " " + line, "en", "a") for k in range(n)]
    base = [f"w{k}" for k in range(70)]
    rows += [(n + k, " ".join(base[k:] + [f"v{j}" for j in range(k)]) + " " + line, "en", "a") for k in range(copies)]
    rows += [(n + copies + k, edited([f"u{j}" for j in range(60)], k % 6, k) + " " + line, "en", "a") for k in range(3 * copies)]
    return rows


@pytest.mark.parametrize("block,hot", [(200, 60), (20, 5)])
def test_jaccard_with_a_line_that_very_many_unlike_sets_hold(spark, block, hot):
    rows = common_line_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(table(spark, rows), 5, 8, 10, block, hot).collect()}
    assert got == brute_components(rows, 5, 8, 10)


def test_meetings_over_batches():
    """Signatures that cross batches, common ones, and marked rows."""
    rows = sorted((x * 4, y) for x, n in ((1, 1), (2, 3), (3, 9), (4, 2), (5, 30), (6, 4)) for y in range(n))
    rows += [(0, 7), (5 * 4 | 2, 99)]
    rows.sort()
    want_common = {(20, y) for y in [*range(30), 99]} | {(12, y) for y in range(9)} | {(0, 7)}
    want_pairs = {(a, 0) for a in range(1, 4)}
    for size in (1, 2, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows[k : k + size]], pa.int64()), pa.array([y for _, y in rows[k : k + size]], pa.int64())], names=["x", "y"]) for k in range(0, len(rows), size)]
        out = [r for b in _meetings(4)(iter(batches)) for r in b.to_pylist()]
        assert {(r["x"], r["a"]) for r in out if r["common"]} == want_common
        assert {(r["a"], r["b"]) for r in out if not r["common"]} == want_pairs
        assert len([r for r in out if not r["common"]]) == 2 + 1 + 3


def test_jaccard_odd_rows(spark):
    got = jaccard_components(table(spark, odd_rows(), True), 3, 9, 10).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert len(got) == len(odd_rows())
    assert by[6] == [(12, 1)] and by[1] == [(12, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)] and by[7][0] == by[7][1]
    assert by[None] == [(9, None)] and by[8] == [(1, 8)] and by[-9] == [(1, -9)]
    assert jaccard_components(table(spark, [])).collect() == []


def test_signatures_meet_for_every_similar_pair():
    r = np.random.default_rng(9)
    for num, den in ((9, 10), (8, 10), (1, 2)):
        for n in [*range(1, 40), 100, 333]:
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            for drop in range(0, n, max(1, n // 6)):
                b = a[drop:]
                b = np.unique(np.concatenate([b, r.integers(0, 1 << 63, min(2, drop)).astype(np.uint64)]))
                inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                if den * inter >= num * union:
                    assert np.intersect1d(signatures(a, num, den), signatures(b, num, den)).size


def test_t_occurrence_search():
    r = np.random.default_rng(11)
    base = r.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, r.integers(30, 60), False), r.integers(0, 1 << 62, r.integers(0, 9)).astype(np.uint64)])) for _ in range(50)]
    lists = Lists(sets)
    for num, den in ((9, 10), (7, 10), (1, 2)):
        for s in sets:
            want = [k for k, t in enumerate(sets) if den * len(np.intersect1d(s, t)) >= num * len(np.union1d(s, t))]
            assert sorted(lists.links(s, num, den).tolist()) == want
            others = [k for k in want if not np.array_equal(sets[k], s)]
            assert sorted(k for k in lists.links(s, num, den, True).tolist() if not np.array_equal(sets[k], s)) == others
    assert lists.links(np.zeros(0, np.uint64), 9, 10).tolist() == []


def test_alike_sets_have_short_lists():
    r = np.random.default_rng(14)
    sets = []
    for base in (r.integers(0, 1 << 62, 400).astype(np.uint64), r.integers(0, 1 << 62, 90).astype(np.uint64)):
        for k in range(120 if len(base) > 200 else 50):
            gone = r.integers(0, 40)
            sets.append(np.unique(np.concatenate([r.choice(base, len(base) - gone, False), r.integers(0, 1 << 62, gone).astype(np.uint64)])))
    lists = Lists(sets)
    assert len(Lists(sets[:120]).owner) * 5 < sum(map(len, sets[:120]))
    for num, den in ((9, 10), (8, 10)):
        for s in sets[::3]:
            want = [k for k, t in enumerate(sets) if den * len(np.intersect1d(s, t)) >= num * len(np.union1d(s, t))]
            assert lists.links(s, num, den).tolist() == want
            assert {*lists.links(s, num, den, True).tolist()} | {k for k in want if np.array_equal(sets[k], s)} == {*want}


def test_fm_index_finds_every_window():
    r = np.random.default_rng(12)
    sequences = [r.integers(1, 5, r.integers(4, 30)) for _ in range(40)]
    index = FMIndex(sequences, 4)
    windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(s, 4) for s in sequences])
    low, high = index.find(windows)
    values = r.permutation(40)
    least = index.least(low, high, values)
    for p, a, b, m in zip(windows.tolist(), low, high, least, strict=True):
        where = [k for k, s in enumerate(sequences) for j in range(len(s) - 3) if s[j : j + 4].tolist() == p]
        assert sorted(index.owner[a:b].tolist()) == sorted(where)
        assert m == min(values[k] for k in where)


@pytest.mark.parametrize("window,size", [(4, 30), (13, 300), (2, 5), (1, 3)])
def test_streams_through_the_index_match_every_window(window, size):
    r = np.random.default_rng(window)
    sequences = [r.integers(1, 4, r.integers(0, size) + 1) for _ in range(30)] + [np.ones(200, np.int64)]
    index = FMIndex(sequences, 3)
    low, high = index.matches(window)
    windows = [s[k : k + window] for s in sequences for k in range(len(s) - window + 1)]
    assert len(low) == len(windows)
    want_low, want_high = index.find(np.array(windows))
    wide = want_high - want_low > 1  # `find` stops at the first interval of one suffix
    assert np.array_equal(low[wide], want_low[wide]) and np.array_equal(high[wide], want_high[wide])
    assert (high[~wide] - low[~wide] == 1).all()
    places = np.array([int(index.starts[k]) + j for k, s in enumerate(sequences) for j in range(len(s) - window + 1)])
    assert np.array_equal(index.suffix[low[~wide]], places[~wide])


def brute_removal(rows, window):
    first = {}
    for d, t, *_ in rows:
        w = BLANK.findall((t or "").encode())
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(d, first.get(g, d))
    out = {}
    for d, t, *_ in rows:
        w = BLANK.findall((t or "").encode())
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < d for j in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1, 5000])
def test_substring_dedup(spark, hot):
    r = random.Random(13)
    passages = [words(r.randint(5, 40), 100 + k, 10) for k in range(8)]
    rows = []
    for d in range(80):
        parts = [words(r.randint(0, 20), d * 7 + j, 10) + r.choice(passages) * r.randint(0, 1) for j in range(3)]
        rows.append((d * 3 - 50, " ".join(sum(parts, [])), "en", "a"))
    rows += [(1000 + k, " ".join(["same"] * k), "en", "a") for k in range(10, 18)] + [(2000, "", "en", "a")]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup(table(spark, rows), hot=hot).collect()}
    assert got == brute_removal(rows, 13)


def test_substring_dedup_odd_rows(spark):
    text = " ".join(words(40, 3, 10))
    rows = odd_rows() + [(50, text, "en", "a"), (50, text, "en", "a"), (51, f"x {text}", "en", "a"), (None, text, "en", "a")]
    got = {}
    for x in substring_dedup(table(spark, rows, True)).collect():
        got.setdefault(x.doc_id, []).append((x.n_words, x.n_removed))
    assert sum(map(len, got.values())) == len(rows)
    assert got[50] == [(40, 0), (40, 0)] and got[51] == [(41, 40)] and sorted(got[None]) == [(11, 0), (40, 0)]
    assert got[6] == [(14, 14)] and got[1] == [(14, 0)] and got[2] == [(0, 0)] and got[7][0] == got[7][1]
    assert substring_dedup(table(spark, [])).collect() == []


def test_raking_meets_reachable_targets(spark):
    r = random.Random(1)
    cells = [(s, l, t, r.randint(50, 2000)) for s in "abc" for l in ("en", "fr") for t in ("p", "q")]
    df = spark.createDataFrame(cells, "c_source string, c_lang string, c_topic string, mass long")
    got = raked(df, {"source": 0.9, "lang": 0.9, "topic": 0.9}, 0.5, rounds=15).collect()
    assert all(x.w <= x.mass + 1e-9 for x in got)
    total = sum(m for *_, m in cells)
    for name, k in (("source", 0), ("lang", 1), ("topic", 2)):
        mass = Counter()
        for c in cells:
            mass[c[k]] += c[3]
        power = {v: m**0.9 for v, m in mass.items()}
        for v, p in power.items():
            have = sum(x.w for x in got if x[f"c_{name}"] == v)
            assert have == pytest.approx(0.5 * total * p / sum(power.values()), rel=1e-3)


def brute_raking(cells, power, budget, rounds):
    total, w = sum(c[3] for c in cells), [budget * c[3] for c in cells]
    for _ in range(rounds):
        for k in range(3):
            mass, sums = Counter(), Counter()
            for c, x in zip(cells, w, strict=True):
                mass[c[k]] += c[3]
                sums[c[k]] += x
            scale = budget * total / sum(m**power for m in mass.values())
            w = [min(x * scale * mass[c[k]] ** power / sums[c[k]], c[3]) for c, x in zip(cells, w, strict=True)]
    return w


def test_raking_goes_on_until_it_settles(spark):
    r = random.Random(7)
    cells = [(s, l, t, r.randint(1, 300) * (40 if s == "hot" and l == "en" else 1)) for s in ("hot", "b", "c", "d", "e") for l in ("en", "fr", "de") for t in "pqr"]
    settled, early = (brute_raking(cells, 0.7, 0.6, n) for n in (300, 10))
    of = lambda w: [sum(x for c, x in zip(cells, w, strict=True) if c[k] == v) for k in range(3) for v in sorted({c[k] for c in cells})]
    assert max(abs(a / b - 1) for a, b in zip(of(early), of(settled), strict=True)) > 5e-3
    df = spark.createDataFrame(cells, "c_source string, c_lang string, c_topic string, mass long")
    found = {(x.c_source, x.c_lang, x.c_topic): x.w for x in raked(df, dict.fromkeys(("source", "lang", "topic"), 0.7), 0.6).collect()}
    assert of([found[c[:3]] for c in cells]) == pytest.approx(of(settled), rel=1e-3)


@pytest.mark.parametrize("clashes", [False, True])
def test_mixing(spark, clashes):
    rows = odd_rows() + [(100 + k, f"some words about number {k}", "en", "a" if k % 3 else "b") for k in range(300)]
    out = mixed(table(spark, rows, clashes)).collect()
    assert len(out) == len(rows)
    assert all(0 <= x.probability <= 1 for x in out)
    again = {(x.doc_id, x.text): x.selected for x in mixed(table(spark, rows[::-1])).collect()}
    assert all(again[x.doc_id, x.text] == x.selected for x in out)
    drawn = sum(x.tokens for x in out if x.selected and (x.doc_id or 0) >= 100)
    expected = sum(x.tokens * x.probability for x in out if (x.doc_id or 0) >= 100)
    assert drawn == pytest.approx(expected, rel=0.25)
    assert mixed(table(spark, [])).collect() == []


def test_schema_of_documents():
    assert SCHEMA.startswith("doc_id long")


def test_token_files_lie_uncompressed_in_the_store(spark, tokenizer):
    """One id is read through a mapping, by the bytes of its file within the stored one."""
    import mmap

    rows = [(k, f"document {k} of words and 123 numbers", "en", "a") for k in range(40)]
    files = write_token_files(table(spark, rows), tokenizer, parts=1)
    (row,) = files.collect()
    path = next(p for p in files.inputFiles() if p.endswith(".parquet")).removeprefix("file:").replace("///", "/")
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as held:
        at = held.find(bytes(row.content))
        assert at > 0
        mapped = TokenFile(memoryview(held)[at : at + len(row.content)])
        whole = TokenFile(bytes(row.content))
        assert [mapped.token(i) for i in (0, 5, whole.n_tokens - 1)] == [whole.token(i) for i in (0, 5, whole.n_tokens - 1)]
        del mapped


def brute_quality(rows, min_documents, host_share, min_words=10, max_removed=0.5):
    """words_removed and kept of every document by sets of documents for each line of a host."""
    plain = lambda x: re.sub("[ \t\n\x0b\x0c\r]+", " ", re.sub("[0-9]", "0", x.strip(" \t\n\x0b\x0c\r").lower()))
    lines = {d: [x for x in (t or "").split("\n") if x.split()] for d, t, *_ in rows}
    body = {d: tuple(map(plain, x)) for d, x in lines.items()}
    holders, hosts = {}, {}
    for d, _, _, host in rows:
        if body[d]:
            hosts.setdefault(host, set()).add(body[d])
            for x in body[d]:
                holders.setdefault((host, x), set()).add(body[d])
    out = {}
    for d, t, _, host in rows:
        n, _, _, _, again = text_counts(t)
        gone = sum(len(x.split()) for x in lines[d] if len(holders[host, plain(x)]) > max(min_documents, host_share * len(hosts[host])))
        stands = n - gone >= min_words and n - gone >= (1 - max_removed) * n
        out[d] = (gone, bool(stands and n >= 10 and 100 * again <= 20 * n))
    return out


@pytest.mark.parametrize("share", [0.0, 0.3])
def test_quality_verdicts_by_brute_force(spark, share):
    r, rows = random.Random(4), []
    common = [f"line {k} that the host {k % 3} prints" for k in range(9)]
    for k in range(240):
        own = [" ".join(words(r.randint(3, 25), 10 * k + j, 10)) for j in range(r.randint(0, 4))]
        text = "\n".join(r.sample(common, r.randint(0, 6)) + own + [""] * (k % 2))
        rows.append((k, text, "en", "abc"[k % 3]))
    rows += [(240 + k, rows[k][1], "en", rows[k][3]) for k in range(30)]
    got = {x.doc_id: (x.words_removed, x.kept) for x in quality_rules(table(spark, rows), min_documents=20, host_share=share).collect()}
    want = brute_quality(rows, 20, share)
    assert got == want and {True, False} == {k for _, k in want.values()} and any(g for g, _ in want.values())


@pytest.mark.parametrize("seed", range(5))
def test_header_and_footer_go_from_every_document(spark, seed):
    head, foot = f"welcome to host {seed} please read on", f"all rights reserved by host {seed} since then"
    rows = [(k, "\n".join([head, " ".join(words(40, 1000 * seed + k, 10)), foot]), "en", "h") for k in range(120)]
    got = quality_rules(table(spark, rows)).collect()
    assert {r.lines_removed for r in got} == {2} and all(r.kept for r in got)


def test_residuals_of_raking(spark):
    cells = [("a", "en", "p", 1000), ("b", "en", "p", 10), ("a", "fr", "q", 500)]
    df = spark.createDataFrame(cells, "c_source string, c_lang string, c_topic string, mass long")
    fitted = raked(df)
    got = {(x.name, x.value): x for x in residuals(df, fitted).collect()}
    assert len(got) == 6
    for (name, value), x in got.items():
        w = sum(r.w for r in fitted.collect() if r[f"c_{name}"] == value)
        assert x.reached == pytest.approx(w) and x.share_off == pytest.approx(1 - w / x.target)


def test_ledger_of_increments_scans_each_blob_once(spark):
    rows = [(k, f"token=abcdefg{k % 3}", "en", "a") for k in range(30)]
    docs = table(spark, rows)
    whole = scan(docs)
    parts = scan_increments(docs, [F.col("doc_id") % 4 == k for k in range(4)])
    key = lambda r: str(r)
    assert sorted(parts.collect(), key=key) == sorted(whole.collect(), key=key) and parts.count() == 3
    assert rows_of(digest(findings(docs, parts))) == rows_of(digest(findings(docs, whole)))


def test_top_k_of_repeated_vectors(spark):
    """Repeated rows lie in several blocks and are candidates each."""
    rows = [(1, [0.5, 0.25]), *[(2, [0.5, 0.5])] * 9, (3, [0.1, 0.9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = exact_top_k(df, F.col("vec_id") == 1, k=4, rows=2, queries=1).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(k, 2) for k in range(1, 5)]


@pytest.mark.parametrize("rows,queries", [(16_384, 1_024), (40, 1)])
def test_top_k_of_repeated_queries(spark, tmp_path, rows, queries):
    """Each row of a repeated query is a query, as in the SQL."""
    import duckdb

    from tesserae.llm.queries import ORACLE_SQL

    r = random.Random(3)
    vector = lambda: [r.uniform(-1, 1) for _ in range(6)]
    data = [(k, vector()) for k in range(-60, 120)]
    data += [*data[60:62], data[60], data[110], (0, vector()), (100, vector()), (7, vector())]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(4).write.parquet(path)
    got = exact_top_k(spark.read.parquet(path), F.col("vec_id") % 50 == 0, rows=rows, queries=queries)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    assert rows_of(got) == sorted(db.execute(ORACLE_SQL["op6_exact_top_k"]).fetchall(), key=lambda x: tuple((True, str(v)) for v in x))


def test_sets_that_share_fewer_parts_than_they_can_spare_do_not_meet(spark, monkeypatch):
    """Groups of unlike sets with a passage in common: each shares a few parts, none of which it has to keep."""
    passage = [[f"p{g}_{k}" for k in range(50)] for g in range(6)]
    rows = [(k, " ".join([f"w{k}_{j}" for j in range(100)] + passage[k % 6]), "en", "a") for k in range(120)]
    rows += [(120 + k, edited(rows[k][1].split(), 2, k), "en", "a") for k in range(6)]
    seen = {}

    def saved(df, label, *more):
        out = common.saved(df, label, *more)
        seen[label] = out
        return out

    monkeypatch.setattr(ngram_join, "saved", saved)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(table(spark, rows), 5, 8, 10).collect()}
    assert got == brute_components(rows, 5, 8, 10) and got[121][1] == 1
    assert seen["join-members"].select("key").distinct().count() <= 24  # the 12 that are linked, and few others


def test_quality_counts_every_document_where_asked(spark):
    """80 copies of a text and 60 unlike ones with a line in common: by documents, the copies' lines go too."""
    own = lambda k: " ".join(words(30, k, 10))
    rows = [(k, f"{own(999)}\nsecond line of the copied text", "en", "h") for k in range(80)]
    rows += [(100 + k, f"one line of all of these\n{own(k)}", "en", "h") for k in range(60)]
    rows += [(100, rows[80][1], "en", "h"), (None, rows[0][1], "en", "h")]
    got = {}
    for once in (True, False):
        for r in quality_rules(table(spark, rows), copies_once=once).collect():
            got.setdefault((once, r.doc_id), set()).add((r.lines_removed, r.kept))
    assert {x for k in range(80) for x in got[True, k]} == {(0, True)} and {x for k in range(80) for x in got[False, k]} == {(2, False)}
    assert {x for once in (True, False) for k in range(60) for x in got[once, 100 + k]} == {(1, True)}
    assert got[True, None] == {(0, True)} and got[False, None] == {(2, False)}
