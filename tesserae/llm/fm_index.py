"""An FM-index over word sequences: suffix order, BWT and a wavelet tree of bitmaps.

Backward search extends a match by the word before it.  Matching statistics of a stream
come from one extension a word: where a match is as long as is asked for, it is first
cut by its last word, to the interval of the suffixes that share the rest.
"""

from __future__ import annotations

import numpy as np


class Bitmap:
    """Bits with a rank directory: the count of set bits before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        raw = np.packbits(bits.astype(np.uint8), bitorder="little")
        padded = np.zeros(-(-len(bits) // 64) * 8 + 8, np.uint8)
        padded[: len(raw)] = raw
        self.words = padded.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletTree:
    """Rank of any symbol in a sequence; one bitmap a level, zeros before ones at the next."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        rest = symbols
        for bit in range(max(1, (n_symbols - 1).bit_length()) - 1, -1, -1):
            on = (rest >> bit) & 1 == 1
            self.levels.append((bit, Bitmap(on), int(len(rest) - on.sum())))
            rest = np.concatenate([rest[~on], rest[on]])

    def narrow(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before low and before high, both less those before the tree's node."""
        start = np.zeros_like(low)
        for bit, bitmap, zeros in self.levels:
            on = (symbol >> bit) & 1 == 1
            a, b, c = bitmap.rank(low), bitmap.rank(high), bitmap.rank(start)
            low, high, start = np.where(on, zeros + a, low - a), np.where(on, zeros + b, high - b), np.where(on, zeros + c, start - c)
        return low - start, high - start


LANE = 64  # windows that a stream is cut into


class FMIndex:
    """Sequences of symbols from 1 on; `find` gives suffix intervals of patterns within one sequence,
    and `matches` those of all windows of the sequences themselves, each streamed once."""

    def __init__(self, sequences: list[np.ndarray], n_symbols: int):
        count = len(sequences)
        lengths = np.array([len(s) + 1 for s in sequences])
        text = np.zeros(int(lengths.sum()), np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        ends = self.starts + lengths - 1
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.concatenate(sequences) if count else []
        owner = np.repeat(np.arange(count), lengths)
        order_of = text + count - 1
        order_of[ends] = np.arange(count)  # ends are symbols of their own, so suffixes differ early
        suffix = self._suffixes(order_of)
        self.text, self.lengths, self.suffix, self.named = text, lengths - 1, suffix.astype(np.int32), order_of
        self.owner = owner[suffix].astype(np.int32)
        self.tree = WaveletTree(text[suffix - 1], n_symbols + 1)
        counts = np.bincount(text, minlength=n_symbols + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))

    @staticmethod
    def _suffixes(symbols: np.ndarray) -> np.ndarray:
        n, width = len(symbols), 1
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        while True:
            later = np.zeros(n, np.int64)
            later[: max(0, n - width)] = rank[width:] + 1
            pair = rank * (n + 1) + later
            order = np.argsort(pair)
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(pair[order][1:] != pair[order][:-1])))
            if not n or rank[order[-1]] == n - 1:
                return order
            width *= 2

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals [low, high) of suffixes that start with each row of symbols, by backward search.

        A pattern found in one place only keeps that one's interval without further steps.
        """
        last = patterns[:, -1]
        low, high = self.first[last].copy(), self.first[last + 1].copy()
        alive = np.flatnonzero(high - low > 1)
        for k in range(patterns.shape[1] - 2, -1, -1):
            if not len(alive):
                break
            symbol = patterns[alive, k]
            a, b = self.tree.narrow(symbol, low[alive], high[alive])
            low[alive], high[alive] = self.first[symbol] + a, self.first[symbol] + b
            alive = alive[b - a > 1]
        return low, high

    def _groups(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For every place in suffix order, where the suffixes that agree with it in `depth` symbols begin and end."""
        n = len(self.text)
        head = np.zeros(n, bool)
        head[:1] = True
        a, b = self.suffix[:-1].astype(np.int64), self.suffix[1:].astype(np.int64)
        for k in range(depth):
            head[1:] |= self.named[np.minimum(a + k, n - 1)] != self.named[np.minimum(b + k, n - 1)]
        at = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        return at[group], np.append(at[1:], n)[group]

    def matches(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of every window of every sequence, in order, by matching statistics capped at
        the window: a stream runs backward through the index, keeps its interval and its length,
        and before a further symbol lets go of the last one where the length is reached.

        Streams run side by side; long ones are cut into lanes that overlap by all but one word of a window.
        """
        counts = np.maximum(self.lengths - window + 1, 0)
        base = np.concatenate(([0], np.cumsum(counts)))
        lanes = -(-counts // LANE)
        seq = np.repeat(np.arange(len(counts)), lanes)
        turn = np.arange(len(seq)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first = turn * LANE  # the lane's first window within its sequence
        size = np.minimum(counts[seq] - first, LANE) + window - 1  # its words
        begin = self.starts[seq] + first
        out_low, out_high = np.zeros(base[-1], np.int64), np.zeros(base[-1], np.int64)
        if not len(seq):
            return out_low, out_high
        shorter, shorter_end = self._groups(window - 1)
        order = np.argsort(-size, kind="stable")
        begin, size, slot = begin[order], size[order], (base[seq] + first)[order]
        low, high = np.zeros(len(order), np.int64), np.full(len(order), len(self.text), np.int64)
        for step in range(int(size[0])):
            live = int(np.searchsorted(-size, -step, side="left"))  # lanes with a word left
            if step >= window:
                low[:live], high[:live] = shorter[low[:live]], shorter_end[low[:live]]
            place = size[:live] - 1 - step
            symbol = self.text[begin[:live] + place]
            a, b = self.tree.narrow(symbol, low[:live], high[:live])
            low[:live], high[:live] = self.first[symbol] + a, self.first[symbol] + b
            if step >= window - 1:
                out_low[slot[:live] + place], out_high[slot[:live] + place] = low[:live], high[:live]
        return out_low, out_high

    def least(self, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The smallest value of the sequences whose suffixes lie in each interval."""
        row = np.append(values[self.owner], np.iinfo(np.int64).max)
        pairs, back = np.unique(np.stack([low, high], axis=1), axis=0, return_inverse=True)
        return np.minimum.reduceat(row, pairs.ravel())[::2][back.ravel()] if len(pairs) else np.zeros(0, np.int64)
