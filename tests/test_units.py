"""Exact cases of the parts that aren't queries."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.config import CanvasConfig
from tesserae.functions import color as C
from tesserae.functions import geometry as G
from tesserae.functions import text as T
from tesserae.operators import batches, canvas, dither, emit, formats, grid, quantize, resample, symbols, terminal, wide
from tesserae.operators.terminal import Sequence, chained, emitted, matched_terminals
from tesserae.plans import glyphs, palettes, sequences
from tesserae.queries_canvas import FIFO_STEPS
from tesserae.sources import decoders, paths
from tesserae.streaming import sources
from tesserae.streaming.fifo import ByteFifo
from tesserae.streaming.parser import Parser, parse_batch, parse_stream


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_byte_fifo_positions():
    """Places count from the front of the queue."""
    f = ByteFifo()
    for step in range(0, len(FIFO_STEPS), 2):
        for op, data, n in FIFO_STEPS[step]:
            f.push(data.encode() * n) if op == "push" else f.drop(n)
        what, place = FIFO_STEPS[step + 1]
        assert f.search(what.encode()) == place
    f = ByteFifo()
    f.push(b"abab")
    at = f.restart(b"abc")
    assert f.search(b"abc", at) == -1 and at == 2
    f.push(b"c\nrest")
    assert f.search(b"abc", at) == 2 and f.search(b"abc", 0) == 2 and f.search(b"abc", 3) == -1
    assert f.split_next(b"\n") == b"ababc" and f.split_next(b"\n") is None and f.peek(9) == b"rest"
    assert f.at == 6 and f.search(b"st", 7) == 2 and f.search(b"re", 0) == 0 and f.pop(2) == b"re" and len(f) == 2


def test_buffer_sizes(spark):
    n = lambda w, h, c, m: one(spark, G.buffer_size(F.lit(w), F.lit(h), F.lit(c), m))[0]
    big = 2**32 - 1
    assert n(big, big, 4, 2**62) is None and n(0, 8, 4, 99) is None and n(8, 0, 4, 99) is None
    assert n(16, 16, 4, 1024) == 1024 and n(16, 16, 4, 1023) is None and n(16, 8, 4, 9999) == 512
    with pytest.raises(ValueError):
        decoders.checked(0, 5)


@pytest.mark.parametrize(
    "seq,args,want",
    [
        (Sequence("a", "soft-reset"), (), "soft-reset"),
        (Sequence("a", "cursor-up-%1", 1, "u16"), (9876,), "cursor-up-9876"),
        (Sequence("a", "%1-cursor-to-pos-%2", 2, "pos"), (1234, 0), "1235-cursor-to-pos-1"),
        (Sequence("a", "%1%2-fg-direct-%3", 3), (41, 0, 244), "410-fg-direct-244"),
        (Sequence("a", "%1%2-fgbg-%3,%4%5-%6", 6), (1, 199, 99, 0, 0, 9), "1199-fgbg-99,00-9"),
        (Sequence("a", "aix%1,", 1, "aix_fg"), (0,), "aix30,"),
        (Sequence("a", "aix%1,", 1, "aix_fg"), (8,), "aix90,"),
        (Sequence("a", "aix%1,", 1, "aix_bg"), (8,), "aix100,"),
        (Sequence("a", "def-fg-%1-%2-%3,", 3, "u16hex"), (0xFFFF, 0, 0x1234), "def-fg-ffff-0000-1234,"),
        (Sequence("a", "def-fg-%1-%2-%3,", 3, "u16hex"), (0x10000, 0, 0), None),
        (Sequence("a", "def-fg-%1-%2-%3,", 3, "u16hex"), (1, 2), None),
        (Sequence("a", "attr-%v,", 0, "u16"), (255, 0, 4660), "attr-255;0;4660,"),
        (Sequence("a", "100%%"), (), "100%"),
    ],
)
def test_sequences(spark, seq, args, want):
    assert seq.emit(*args) == want
    if "%v" not in seq.template:
        assert one(spark, emitted(seq, [F.lit(a) for a in args]))[0] == want
    if want is not None and "%1%2" not in seq.template and not seq.kind.startswith("aix"):
        assert seq.parse(want) == ("success", list(args), len(want))


def test_sequence_parse_states():
    s = Sequence("a", "def-fg-%1-%2-%3,", 3, "u16hex")
    text = "def-fg-ffff-0000-1234,"
    assert {s.parse(text[:k])[0] for k in range(len(text))} == {"again"}
    assert s.parse("deg-fg-")[0] == "failure" and s.parse("def-fg-x")[0] == "failure"


def test_parser_in_any_pieces(spark):
    data = b"a\x1b[A\xc3\xa9\x1b[3;4R\x1b]10;rgb:ffff/0000/1234\x1b\\\xff\x1b[?1;2cz\x1b"
    whole = list(Parser().push(data, True))
    assert [e[1] or e[2] or e[0] for e in whole] == ["a", "up_key", "é", "cursor_position", "default_fg", "primary_device_attributes", "z", "\x1b", "eof"]
    assert whole[3][3] == [2, 3] and whole[4][3] == [0xFFFF, 0, 0x1234]
    for size in (1, 2, 5):
        p, out = Parser(), []
        for k in range(0, len(data), size):
            out += p.push(data[k : k + size])
        assert out + list(p.push(b"", True)) == whole
    chunks = spark.createDataFrame([(1, k, bytearray(data[k : k + 3])) for k in range(0, len(data), 3)], "stream_id long, part_no long, data binary")
    assert [r.kind for r in parse_batch(chunks).orderBy("seq_no").collect()] == [e[0] for e in whole]


def test_exit_codes(spark):
    code = lambda *ok: grid.exit_code(spark.createDataFrame([(x,) for x in ok], "ok boolean")).first()[0]
    assert (code(True), code(True, True), code(True, False), code(False), code()) == (0, 0, 1, 2, 2)


def test_config_rules():
    assert [CanvasConfig(work=w).work_factor for w in range(1, 10)] == [0, 1, 3, 4, 5, 6, 8, 9, 10]
    assert CanvasConfig(work=7).candidates is None and CanvasConfig(work=1).candidates == 1
    assert CanvasConfig(mode="truecolor", dither="ordered").dither == "none"
    assert CanvasConfig(mode="16", dither="ordered").similar(width=9).width == 9
    with pytest.raises(ValueError):
        CanvasConfig(mode="17")


def test_bayer_is_balanced():
    for n in (2, 4, 8, 16):
        t = dither.bayer(n)
        assert len(set(t)) >= n * n - 1 and min(t) >= -128 and max(t) <= 127 and t[0] == min(t)


def test_diffusion_keeps_the_mean_and_transparency(spark):
    palette = np.array([[0, 0, 0], [255, 255, 255]], float)
    image = np.full((32, 32, 4), 255.0)
    image[:, :, :3] = 100
    image[0, :, 3] = 0
    for forward in (True, False):
        pens = dither.diffused_pens(image[None], palette, forward, 1.0)[0]
        assert (pens[0] == -1).all() and pens[1:].mean() == pytest.approx(100 / 255, abs=0.03)


def test_merging_keeps_far_colours():
    mean = np.array([[0, 0, 0], [2, 2, 2], [250, 0, 0], [252, 2, 0], [0, 0, 250]], float)
    out = quantize.merged(mean, np.ones(5), 3)
    assert sorted(map(tuple, out.astype(int).tolist())) == [(0, 0, 250), (1, 1, 1), (251, 1, 0)]
    axes, _ = quantize.principal_axes(np.array([[k, 2 * k, 0] for k in range(-5, 6)], float), 1)
    assert np.abs(axes[0]) == pytest.approx([0.447, 0.894, 0], abs=1e-3)


def test_scaler_choice():
    names = [resample.filter_for(s, d) for s, d in ((1, 9), (8, 8), (6000, 20), (300, 20), (100, 10), (50, 10), (25, 10), (15, 10), (5, 10))]
    assert names == ["one", "copy", "box128", "box", "bilinear3", "bilinear2", "bilinear1", "bilinear0", "bilinear0"]
    for src, dest in ((64, 5), (7, 3), (3, 7)):
        taps = resample.box_taps(src, dest)
        assert {o: sum(w for _, p, w in taps if p == o) for o in range(dest)} == dict.fromkeys(range(dest), src)


def test_selectors():
    assert [s.add for s in symbols.parse_selectors("+block-half")] == [True, False]
    assert symbols.parse_selectors("[a\\]b]")[1:] == [symbols.Selector(True, 0, ord(c), ord(c)) for c in "a]b"]
    for bad in ("nothing-like-this", "[abc"):
        with pytest.raises(ValueError):
            symbols.parse_selectors(bad)


def test_black_and_white_glyphs(spark):
    counts = {g[2]: g[6] for g in glyphs.glyph_rows()}
    assert counts[" "] == 0 and counts["█"] == 64 and counts["▀"] == 32 and counts["⣿"] == 32
    assert len({g[1] for g in glyphs.glyph_rows()}) == len(glyphs.glyph_rows())


def test_palette_order():
    assert len(palettes.palette256()) == 256 and palettes.in_tie_order(palettes.palette256())[0][0] == 16


def test_passthrough_and_sixels(spark):
    s = F.lit("\x1bx" * 150)
    assert one(spark, emit.passthrough(s, "screen"))[0].count("\x1bP") == 2
    assert one(spark, emit.passthrough(s, "tmux"))[0].count("\x1b\x1b") == 150
    runs = [one(spark, emit.repeated_sixel(F.lit("~"), F.lit(n)))[0] for n in (1, 3, 4, 254, 255, 260)]
    assert runs == ["~", "~~~", "!4~", "!254~", "!255~", "!255~!5~"]


def test_text_edges(spark):
    assert one(spark, T.ellipsized(F.lit("abcd"), 3), T.ellipsized(F.lit("abcde"), 3), T.ellipsized(F.lit(None).cast("string"), 3), T.ellipsized(F.lit("abc"), 0)) == ("abcd", "abc…", "", "")
    assert one(spark, T.fraction(F.lit("4/2")), T.fraction(F.lit("1:0")), T.duration(F.lit("2.5s")), T.leading_hex(F.lit("fffz"))) == (2.0, None, 2.5, 0xFFF)


def test_colour_edges(spark):
    assert one(spark, C.cube_index(F.lit(0), F.lit(255), F.lit(95))) == (16 + 6 * 5 + 1,)
    l, u, v = one(spark, *C.din99d(F.lit(255), F.lit(255), F.lit(255)))
    assert 245 <= l <= 255 and abs(u - 128) <= 12 and abs(v - 128) <= 12
    assert one(spark, C.average(F.lit(255), F.lit(1)), C.normalized(F.lit(77), F.lit(5), F.lit(5))) == (127, 77)


def test_paths_and_colours(spark):
    t = spark.createDataFrame([("a\r\n\nb\nc",)], "t string")
    assert [r.path for r in paths.queued(paths.from_list(spark, ["z"], 1), paths.split_tokens(t, "t")).collect()] == ["a", "b", "c", "z"]
    c = spark.createDataFrame([("Navy",), ("na vy",), ("nope",)], "n string")
    assert [r.rgb for r in paths.named_color(c, "n").collect()] == [0x80, 0x80, None]


def test_cell_edits_mend_wide_characters(spark):
    row = spark.createDataFrame([(1, k, 0, "W" if k == 2 else "" if k == 3 else "a", 2 if k == 2 else 0 if k == 3 else 1) for k in range(6)], "image_id long, cx long, cy long, ch string, width int")
    write = lambda *e: "".join(r.ch or "_" for r in grid.edited(row, spark.createDataFrame(e, row.schema)).orderBy("cx").collect())
    assert write((1, 0, 0, "x", 1)) == "xaW_aa" and write((1, 3, 0, "x", 1)) == "aa xaa" and write((1, 4, 0, "V", 2)) == "aaW_V_"


def test_terminals(spark):
    env = spark.createDataFrame([(1, "TERM", "x"), (2, "TERM", "y")], "session_id long, name string, value string")
    rules = spark.createDataFrame([("any", "TERM", None, 1), ("x", "TERM", "x", 1)], "term string, name string, value string, priority int")
    assert {r.session_id: r.term for r in matched_terminals(env, rules).collect()} == {1: "x", 2: "any"}
    seqs = lambda *r: spark.createDataFrame(r, "seq string, template string")
    assert {r.seq: (r.template, r.origin) for r in chained(seqs(("a", "1"), ("b", "2")), seqs(("b", "3"))).collect()} == {"a": ("1", "outer"), "b": ("3", "inner")}


def png(image: np.ndarray, kinds) -> bytes:
    h, w, _ = image.shape
    rows, before = [], np.zeros(w * 4, np.uint8)
    for y in range(h):
        line, kind = image[y].reshape(-1), kinds[y % len(kinds)]
        left = np.concatenate([np.zeros(4, np.uint8), line[:-4]])
        rows.append(bytes([kind]) + {0: line, 1: line - left, 2: line - before, 3: line - ((left.astype(int) + before) // 2).astype(np.uint8)}[kind].astype(np.uint8).tobytes())
        before = line
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(rows))) + part(b"IEND", b"")


def gif(pens: list[list[int]], colors: list[tuple]) -> bytes:
    h, w = len(pens), len(pens[0])
    bits = "".join(format(c, "03b")[::-1] for p in sum(pens, []) for c in (4, p)) + format(5, "03b")[::-1]
    body = bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    table = b"".join(bytes(c) for c in colors)
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + table + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x02" + bytes([len(body)]) + body + b"\0;"


def test_decoders(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 256, (5, 4, 4)).astype(np.uint8)
    assert list(decoders.decode_png(png(image, (0, 1, 2, 3)))) == [(0, 4, 5, image.tobytes())]
    colors = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]
    (_, w, h, data), = decoders.decode_gif(gif([[0, 1], [2, 3]], colors))
    assert (w, h) == (2, 2) and data == b"".join(bytes(c) + b"\xff" for c in colors)
    qoi = b"qoif" + struct.pack(">IIBB", 3, 1, 4, 0) + b"\xff\x01\x02\x03\x04" + b"\xc1"
    assert list(decoders.decode_qoi(qoi)) == [(0, 3, 1, b"\x01\x02\x03\x04" * 3)]
    head = [100, 7, 2, 24, 2, 1, 0, 1, 32, 1, 32, 32, 8, 4, 0xFF0000, 0xFF00, 0xFF, 8, 0, 0, 2, 1, 0, 0, 0]
    assert list(decoders.decode_xwd(struct.pack(">25I", *head) + b"\0\1\2\3\0\4\5\6")) == [(0, 2, 1, b"\1\2\3\xff\4\5\6\xff")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/x.png").write_bytes(png(image, (0,)))
    frame = decoders.read_with_builtin(spark, str(tmp_path / "j")).first()
    assert (frame.width, frame.height, frame.pixel_type) == (4, 5, "BGRA8_UNASSOCIATED") and bytes(frame.data) == image[:, :, [2, 1, 0, 3]].tobytes()
    for name, data in (("a.png", png(image, (2,))), ("b.qoi", qoi), ("c.txt", b"nothing"), ("d.png", b"\x89PNG\r\n\x1a\nbroken")):
        (tmp_path / name).write_bytes(data)
    frames = decoders.decode_frames(decoders.read_images(spark, str(tmp_path))).collect()
    by = {r.path[-5:]: r for r in frames}
    assert by["a.png"].width == 4 and by["b.qoi"].error is None and by["c.txt"].error == "Unknown file format" and by["d.png"].error
    px = formats.frame_pixels(decoders.decode_frames(decoders.read_images(spark, str(tmp_path / "a.png")))).orderBy("y", "x").collect()
    assert [(p.r, p.g, p.b, p.a) for p in px] == [tuple(v) for v in image.reshape(-1, 4).tolist()]


def test_entry_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['tesserae.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'glyph_usage' in q and not any(k[:2] == 'op' and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_wide_lookback(spark):
    r = np.random.default_rng(3)
    rows = [(1, y, x, *(int(v) for v in r.integers(0, 100, 3))) for y in range(6) for x in range(20)]
    df = spark.createDataFrame(rows, "image_id long, cy long, cx long, err long, wide_left_err long, wide_right_err long")
    want = {}
    for y in range(6):
        row = [q for q in rows if q[1] == y]
        kinds = []
        for k, q in enumerate(row):
            if k and kinds[-1] != "right" and row[k - 1][4] + q[5] < row[k - 1][3] + q[3]:
                kinds[-1:] = ["left", "right"]
            else:
                kinds.append("narrow")
        want |= {(y, x): k for x, k in enumerate(kinds)}
    assert {(g.cy, g.cx): g.kind for g in wide.wide_lookback(wide.pair_errors(df)).collect()} == want


def grains_by_hand(image, palette, gw, gh, intensity):
    """Serpentine diffusion by grains, one number at a time."""
    h, w = len(image), len(image[0])
    image = [[list(p) for p in row] for row in image]
    error = {}
    cut = lambda e, k: int(abs(e) * k / 16) * (1 if e >= 0 else -1)
    for y in range(h // gh):
        across = range(w // gw) if y % 2 == 0 else range(w // gw - 1, -1, -1)
        step = 1 if y % 2 == 0 else -1
        for x in across:
            over, mean = [0, 0, 0], [0, 0, 0]
            for v in range(y * gh, y * gh + gh):
                for u in range(x * gw, x * gw + gw):
                    for c in range(3):
                        n = image[v][u][c] + error.get((x, y, c), 0)
                        image[v][u][c] = min(255, max(0, n))
                        over[c] += n - image[v][u][c]
                        mean[c] += image[v][u][c]
            mean = [m // (gw * gh) for m in mean]
            near = min(palette, key=lambda p: sum((a - b) ** 2 for a, b in zip(p, mean, strict=True)))
            for c in range(3):
                e = int(over[c] // (gw * gh) + (mean[c] - near[c]) * intensity)
                for dx, dy, k in ((step, 0, 7), (step, 1, 1), (0, 1, 5), (-step, 1, 3)):
                    error[x + dx, y + dy, c] = error.get((x + dx, y + dy, c), 0) + cut(e, k)
    return image


@pytest.mark.parametrize("grain,intensity", [((1, 1), 1.0), ((2, 2), 1.0), ((4, 2), 0.6)])
def test_grain_diffusion_by_hand(spark, grain, intensity):
    r = np.random.default_rng(5)
    images = r.integers(0, 256, (2, 8, 8, 3))
    palette = [p[1:] for p in palettes.palette16()]
    want = np.array([grains_by_hand(i.tolist(), palette, *grain, intensity) for i in images])
    assert np.array_equal(dither.diffused_grains(images, np.array(palette), grain, intensity), want)
    rows = [(k, x, y, *map(int, images[k, y, x]), 255) for k in range(2) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(rows, "image_id long, x long, y long, r long, g long, b long, a long")
    got = {(p.image_id, p.y, p.x): (p.r, p.g, p.b) for p in dither.grain_diffusion(df, palettes.palette16(), grain, intensity).collect()}
    assert all(got[k, y, x] == tuple(want[k, y, x]) for k, y, x in got) and len(got) == 128


def test_indexed_diffusion_takes_images_together():
    r = np.random.default_rng(6)
    images = r.integers(0, 256, (3, 6, 7, 4)).astype(float)
    images[1, 2] = 0
    palette = np.array([p[1:] for p in palettes.palette16()], float)
    whole = dither.diffused_pens(images, palette, False)
    for k in range(3):
        assert np.array_equal(whole[k], dither.diffused_pens(images[k : k + 1], palette, False)[0])
    assert (whole[1, 2] == -1).all()


def test_cleaning_makes_room_for_the_transparent_pen():
    colors = np.array([[k, k, k] for k in range(256)])
    few = quantize.cleaned(colors)
    assert len(few) == 100 and len(quantize.cleaned(colors[::9], 0)) == 30
    many = np.array([[k * 3 % 256, k, 255 - k] for k in range(256)])
    assert len(quantize.cleaned(many, 5)) == 256
    assert quantize.sample_step(4096, 5) == 1 and quantize.sample_step(1 << 21, 5) == 8


def tiff(image: np.ndarray, order: str, pack: int, predictor: int = 1, tile: int = 0, orientation: int = 1) -> bytes:
    h, w, n = image.shape
    parts = [image[y : y + 3] for y in range(0, h, 3)] if not tile else [np.pad(p := image[y : y + tile, x : x + tile], ((0, tile - p.shape[0]), (0, tile - p.shape[1]), (0, 0))) for y in range(0, h, tile) for x in range(0, w, tile)]
    if predictor == 2:
        parts = [np.concatenate([p[:, :1], np.diff(p.astype(int), axis=1).astype(np.uint8)], axis=1) for p in parts]
    squeeze = {1: bytes, 8: zlib.compress, 32773: lambda d: b"".join(bytes([len(d[k : k + 100]) - 1]) + d[k : k + 100] for k in range(0, len(d), 100))}[pack]
    raws = [squeeze(p.astype(np.uint8).tobytes()) for p in parts]
    body, at, offsets = b"", 8, []
    for raw in raws:
        offsets.append(at + len(body))
        body += raw
    where = [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, [len(x) for x in raws])] if tile else [(273, 4, offsets), (278, 3, [3]), (279, 4, [len(x) for x in raws])]
    tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [8] * n), (259, 3, [pack]), (262, 3, [2 if n > 2 else 1]), (274, 3, [orientation]), (277, 3, [n]), (317, 3, [predictor]), *where]
    entries, extra, base = b"", b"", 8 + len(body) + 2 + 12 * len(tags) + 4
    for tag, kind, values in sorted(tags):
        data = struct.pack(order + str(len(values)) + {3: "H", 4: "I"}[kind], *values)
        if len(data) > 4:
            data, extra = struct.pack(order + "I", base + len(extra)), extra + data
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(body))
    return head + body + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0" + extra


@pytest.mark.parametrize("order,pack,predictor,tile,n", [("<", 1, 1, 0, 4), (">", 8, 2, 0, 3), ("<", 32773, 1, 0, 1), (">", 8, 1, 4, 3)])
def test_tiff(order, pack, predictor, tile, n):
    image = np.random.default_rng(2).integers(0, 256, (7, 5, n)).astype(np.uint8)
    rgba = np.full((7, 5, 4), 255, np.uint8)
    rgba[:, :, : 4 if n == 4 else 3] = image
    assert list(decoders.decode_tiff(tiff(image, order, pack, predictor, tile))) == [(0, 5, 7, rgba.tobytes())]
    turned = list(decoders.decode_tiff(tiff(image, order, pack, predictor, tile, 6)))
    assert turned == [(0, 7, 5, np.ascontiguousarray(np.rot90(rgba, -1)).tobytes())]


def test_tiff_lzw_and_the_image_protocol(spark):
    codes, text = [256, 65, 66, 258, 260, 65, 257], b"ABABABAA"
    bits = "".join(format(c, "09b") for c in codes)
    data = bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))
    assert decoders._tiff_lzw(data) == text
    raw = bytes(range(24))
    shown = one(spark, emit.iterm2_text(F.lit(raw), 3, 2, 4, 5))[0]
    file = __import__("base64").b64decode(shown.split(":", 1)[1][:-1])
    assert list(decoders.decode_tiff(file)) == [(0, 3, 2, raw)]  # a reader takes what is sent


def test_jpeg_orientation():
    exif = b"Exif\0\0II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHH", 274, 3, 1, 6, 0)
    jpeg = b"\xff\xd8\xff\xe0\0\4xx\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xd9"
    assert decoders.jpeg_orientation(jpeg) == 6 and decoders.jpeg_orientation(b"\xff\xd8\xff\xd9") == 1


def test_other_decoders_can_be_added(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(b"RAW1\1\2\3\4")
    mine = (("RAW", b"RAW1", 0, lambda data: iter([(0, 1, 1, data[4:8])])),)
    (frame,) = decoders.decode_frames(decoders.read_images(spark, str(tmp_path)), mine).collect()
    assert (frame.width, bytes(frame.data), frame.error) == (1, b"\1\2\3\4", None)


def test_virtual_placement(spark):
    marks = emit.row_column_marks()
    assert [ord(c) for c in marks[:8]] == [0x305, 0x30D, 0x30E, 0x310, 0x312, 0x33D, 0x33E, 0x33F]
    text = one(spark, emit.kitty_virtual_text(F.lit(bytes(8)), 2, 1, 2, 2, F.lit(300), "tmux"))[0]
    assert text.startswith("\x1bPtmux;\x1b\x1b_Ga=T,U=1,q=2,f=32,s=2,v=1,c=2,r=2,i=46,m=1\x1b\x1b\\\x1b\\")
    cell = "\U0010eeee"
    rows = [f"\x1b[38;5;46m{cell}{marks[y]}{marks[0]}{cell}{marks[y]}{marks[1]}" for y in (0, 1)]
    assert text.endswith(rows[0] + "\x1b[2D\x1bD" + rows[1] + "\x1b[39m")
    plain = one(spark, emit.kitty_virtual_text(F.lit(bytes(8)), 2, 1, 2, 1, F.lit(0), "screen"))[0]
    assert plain.endswith(f"\x1b[38;5;1m{cell}{marks[0]}{cell}\x1b[39m")


def test_packets_of_bytes(spark):
    text = "é" * 150
    got = one(spark, emit.passthrough_bytes(F.encode(F.lit(text), "UTF-8"), "screen"))[0]
    parts = bytes(got).split(b"\x1b\\")
    assert [len(p) for p in parts] == [202, 102, 0] and b"".join(p[2:] for p in parts) == text.encode()
    assert one(spark, emit.passthrough(F.lit(text), "none"))[0] == text


def test_streams_equal_batches(spark, tmp_path):
    """Events of chunks that arrive in files, one a trigger, are those of the whole."""
    data = b"a\x1b[1;5Bq\x1b[6;20;10t\xc3\xa9\x1b[24~z"
    rows = [(s, k, bytearray(data[k * 3 : k * 3 + 3])) for s in (1, 2) for k in range(-(-len(data) // 3))]
    for k in range(-(-len(data) // 3)):
        spark.createDataFrame([r for r in rows if r[1] == k], "stream_id long, part_no long, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id long, part_no long, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = parse_stream(stream).writeStream.format("memory").queryName("parsed_events").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.stream_id, r.seq_no, r.kind, r.ch, r.seq, r.args) for r in spark.table("parsed_events").collect())
    want = sorted((r.stream_id, r.seq_no, r.kind, r.ch, r.seq, r.args) for r in parse_batch(spark.createDataFrame(rows, "stream_id long, part_no long, data binary")).where("kind <> 'eof'").collect())
    assert [(r[0], r[2], r[3], r[4], r[5]) for r in got] == [(r[0], r[2], r[3], r[4], r[5]) for r in want] and len(got) == 14


def test_token_streams_and_watched_folders(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_bytes(b"one\r\n\ntwo\nlast")
    written = sources.write_text(sources.token_stream(spark, str(tmp_path / "t")), str(tmp_path / "out"), str(tmp_path / "c1"))
    written.awaitTermination()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["last", "one", "two"]
    (tmp_path / "i").mkdir()
    (tmp_path / "i/a.png").write_bytes(png(np.full((2, 2, 4), 9, np.uint8), (0,)))
    frames = decoders.decode_frames(sources.watched_images(spark, str(tmp_path / "i")))
    query = frames.select("width", "error").writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("watched").collect()] == [(2, None)]


def test_fonts_from_images(spark):
    r = np.random.default_rng(8)
    rows = [(0, x, y, *([int(r.integers(0, 2)) * 255] * 3), 255) for y in range(32) for x in range(32)]
    df = spark.createDataFrame(rows, "image_id long, x long, y long, r long, g long, b long, a long")
    found = batches.crops(df, 32, 32, 25)
    by = {(x, y): c for _, x, y, c, *_ in rows}
    places = {(g.hi << 32 | g.lo) for g in found.collect()}
    every = {sum((by[x + k % 8, y + k // 8] > 0) << (63 - k) for k in range(64)) for x in range(25) for y in range(25)}
    assert found.count() == 25 and places <= every
    font = batches.font_of(df, 32, 32, 4, 25)
    lines = [r.line for r in batches.font_lines(font).orderBy("place").collect()]
    assert lines[0] == "STARTFONT 2.1" and lines[-1] == "ENDFONT" and lines[4] == f"CHARS {font.count()}"
    assert "\n".join(lines).count("STARTCHAR U+E0") == font.count() and font.count() <= 4
    dot = spark.createDataFrame([(0x41, 1 << 31, 1)], "code_point int, hi long, lo long")
    assert batches.c_table(dot).first().line == "{ 0x41, 0x8000000000000001ULL },"
    assert batches.svg_glyphs(dot).first().text.count("<rect") == 2 and 'x="7" y="7"' in batches.svg_glyphs(dot).first().text


def test_terminal_chains():
    known = {t.identifier: t for t in sequences.TERMINALS}
    name, seqs = terminal.chain_of([known["mlterm"], known["tmux"]])
    assert name == "mlterm/tmux" and seqs["begin_sixels"][0] == "\x1bP%1;%2;%3q" and "begin_iterm2_image" not in seqs
    assert "begin_kitty_immediate_image_v1" not in seqs and seqs["begin_tmux_passthrough"][0] == "\x1bPtmux;"
    assert terminal.chain_of([]) == ("dumb", {}) and len(sequences.TERMINALS) == 42
    assert len({n for n, *_ in sequences.ALL}) == len(sequences.ALL) >= 140
    keys = {n: t for n, t, *_ in sequences.KEYS}
    assert keys["up_key"] == "\x1b[A" and keys["f1_key"] == "\x1bOP" and keys["f12_shift_key"] == "\x1b[24;2~" and keys["home_ctrl_key"] == "\x1b[1;5H"


def test_canvas_of_an_image_in_every_mode(spark):
    r = np.random.default_rng(9)
    rows = [(0, x, y, *map(int, r.integers(0, 256, 3)), 255) for y in range(16) for x in range(16)]
    df = spark.createDataFrame(rows, "image_id long, x long, y long, r long, g long, b long, a long")
    for mode in ("truecolor", "240", "16", "16/8", "8", "fgbg_bgfg", "fgbg"):
        config = CanvasConfig(width=3, height=2, mode=mode, symbols="block+space", dither="diffusion" if mode == "16" else "none", dither_grain=(4, 4))
        (row,) = canvas.canvas_text(df, (16, 16), config).collect()
        plain = __import__("re").sub("\x1b\\[[0-9;]*m", "", __import__("re").sub("(.)\x1b\\[([0-9]+)b", lambda m: m[1] * (1 + int(m[2])), row.text))
        assert [len(x) for x in plain.split("\n")] == [3, 3] and ("\x1b" in row.text) == (mode != "fgbg")
    for pixel_mode, start in (("sixels", "\x1bP"), ("kitty", "\x1b_G"), ("iterm2", "\x1b]1337")):
        (row,) = canvas.canvas_text(df, (16, 16), CanvasConfig(width=1, height=1, mode="256", pixel_mode=pixel_mode)).collect()
        assert row.text.startswith(start)
