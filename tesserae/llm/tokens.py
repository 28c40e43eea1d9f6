"""Byte-level BPE ids by the tokenizers library, with a cache of repeated words.

A byte-level pre-tokenizer starts a token at a single space or line feed that
stands between two characters that aren't white space, and splits letters from
the punctuation behind them.  A text cut there can be encoded piece by piece, and
frequent pieces once only.  Texts with other white space are cut at fewer places,
so the ids are always those of the whole text.
"""

from __future__ import annotations

import gc
import json
import string
from array import array

import numpy as np

from .common import worker_threads

CACHE_PIECES = 1_400_000
PIECE_CHARS = 64
_TAIL = string.punctuation


def _byte_alphabet() -> dict[int, str]:
    """Byte to character of byte-level vocabularies: printable Latin-1 as itself, others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_ALPHABET = _byte_alphabet()


class Encoder:
    def __init__(self, path: str):
        worker_threads()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        mark = self.whole(["\n"])[0]
        self.mark = int.from_bytes(mark, "little") if len(mark) == 4 and self.by_piece else None
        self.feed = mark
        self.split = Tokenizer.from_file(path)  # for words that are one pre-token each
        self.split.pre_tokenizer = WhitespaceSplit()
        self.cache: dict[str, bytes] = {}
        self.limit = CACHE_PIECES
        self.tails: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pieces, each as it stands in a text.

        Pieces of letters alone, behind a space or a line feed, are one pre-token; many go
        to the library at once in its byte alphabet, with line feeds between them.
        """
        plain = [p for p in words if (p[1:] if p[0] == "\n" else p).isalpha()] if self.mark is not None else []
        out: dict[str, bytes] = {}
        for at in range(0, len(plain), 500):
            some = plain[at : at + 500]
            shown = [p[1:] if p[0] == "\n" else " " + p for p in some]
            line = f" {_ALPHABET[10]} ".join([p.encode().decode("latin1").translate(_ALPHABET) for p in shown])
            ids = np.array(self.split.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) == len(some) - 1:
                raw, ends = ids.tobytes(), [*(cut * 4).tolist(), len(ids) * 4]
                start = 0
                for p, end in zip(some, ends, strict=True):
                    out[p] = self.feed + raw[start:end] if p[0] == "\n" else raw[start:end]
                    start = end + 4
        rest = [p for p in words if p not in out]
        out.update(zip(rest, self.whole([p if p[0] == "\n" else " " + p for p in rest]), strict=True))
        return out

    def pieces(self, text: str) -> list[str]:
        """The first piece, then pieces that begin with a line feed or lack their leading space."""
        if " ".join(text.split()) == text.replace("\n", " "):
            return text.replace("\n", " \n").split(" ")
        cut = text.split(" ")
        out, last = [cut[0]], cut[0]
        for p in cut[1:]:
            if p and last and not p[0].isspace() and not last[-1].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
            last = p
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text (null: empty) its ids as little-endian unsigned 32-bit integers."""
        texts = [t or "" for t in texts]
        if not self.by_piece:
            return self.whole(texts)
        on = gc.isenabled()
        gc.disable()  # the many strings held here form no cycles
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.limit:
            self.cache.clear()
        cache, tails, firsts, cut, rows, new = self.cache, self.tails, [], [], [], set()
        for t in texts:
            pieces = [t] if any(s in t for s in self.special) else self.pieces(t)
            firsts.append(pieces[0])
            del pieces[0]
            got = list(map(cache.get, pieces))
            holes = []
            at = -1
            for _ in range(got.count(None)):
                at = got.index(None, at + 1)
                holes.append((at, pieces[at]))
                new.add(pieces[at])
            rows.append(got)
            cut.append(holes)
        extra, ended = {}, []
        for p in new:
            base = p.rstrip(_TAIL)
            if base.isalpha() and len(base) < len(p):
                ended.append((p, base, p[len(base) :]))
                p = base
            if p not in cache:
                extra[p] = b""
        extra = self.words(list(extra))
        unknown = [t for t in {tail for _, _, tail in ended} if t not in tails]
        tails.update(zip(unknown, self.whole(unknown), strict=True))
        for p, base, tail in ended:
            extra[p] = (extra.get(base) or cache[base]) + tails[tail]
        cache.update((p, i) for p, i in extra.items() if len(p) <= PIECE_CHARS)
        if len(tails) > CACHE_PIECES:
            tails.clear()
        out = []
        for first, got, holes in zip(self.whole(firsts), rows, cut, strict=True):
            for at, p in holes:
                got[at] = extra[p]
            out.append(first + b"".join(got))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str, limit: int = CACHE_PIECES) -> Encoder:
    """One encoder for each Python worker and vocabulary; limit: pieces that its cache may hold."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].limit = limit
    return _encoders[path]


def release() -> None:
    """Forget this worker's encoders and give their memory back."""
    import ctypes

    _encoders.clear()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
