"""A compressed FM-index of many short sequences, and matching statistics by backward search.

The Burrows-Wheeler transform of all sequences lies in a wavelet tree whose shape follows the
symbols' frequencies (codes of -log2 of their share, rounded up), so that it takes about the
entropy of the text. A step of the backward search takes one rank on each level for both ends of
an interval; all sequences are searched at once, as arrays.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Ranks of symbols 0 to ``sigma`` - 1 in a sequence."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        counts = np.maximum(np.bincount(symbols, minlength=sigma), 1)
        self.sizes = np.maximum(1, np.ceil(np.log2(counts.sum() / counts)).astype(np.int64))
        self.depth = depth = int(self.sizes.max())
        by_size = np.argsort(self.sizes, kind="stable")
        spans = np.int64(1) << (depth - self.sizes[by_size])
        codes = np.empty(sigma, np.int64)  # left-aligned; their order is that of ``by_size``
        codes[by_size] = np.cumsum(spans) - spans
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.starts: list[np.ndarray] = []  # by symbol: where its node begins on a level
        self.ones: list[np.ndarray] = []  # by symbol: ones of the level before that place
        self.sides: list[np.ndarray] = []
        rest, sizes = codes[symbols], self.sizes[symbols]
        for level in range(depth):
            side = (rest >> (depth - 1 - level)) & 1
            packed = np.packbits(side.astype(np.uint8), bitorder="little")
            data = np.zeros(len(side) // 64 + 1, "<u8")
            data.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(data[:-1]), dtype=np.int64)])
            self.levels.append((data, before))
            start = np.searchsorted(rest >> (depth - level), codes >> (depth - level)) if level else np.zeros(sigma, np.int64)
            self.starts.append(start)
            self.ones.append(self._ones(level, start))
            self.sides.append(((codes >> (depth - 1 - level)) & 1).astype(bool))
            stay = sizes > level + 1
            rest, sizes = rest[stay], sizes[stay]
            order = np.argsort(rest >> (depth - 1 - level), kind="stable")
            rest, sizes = rest[order], sizes[order]

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        data, before = self.levels[level]
        word = at >> 6
        return before[word] + np.bitwise_count(data[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place beside it."""
        out = at.astype(np.int64)
        active = np.arange(len(out))
        for level in range(self.depth):
            if level:
                active = active[self.sizes[symbols[active]] > level]
                if not len(active):
                    break
            symbol, place = symbols[active], out[active]
            ones = self._ones(level, self.starts[level][symbol] + place) - self.ones[level][symbol]
            out[active] = np.where(self.sides[level][symbol], ones, place - ones)
        return out


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The order of all suffixes; the symbols at ``ends`` are separators, each different and below all others.

    By doubling: suffixes ordered by their first k symbols are ordered by 2k from pairs of ranks.
    """
    n = len(symbols)
    first = symbols + len(ends)
    first[ends] = np.arange(len(ends))
    _, rank = np.unique(first, return_inverse=True)
    k = 1
    while True:
        pair = rank * (n + 1)
        pair[:-k] += rank[k:] + 1
        order = np.argsort(pair)
        new = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
        if new[-1] == n - 1 or k >= n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2


class FmIndex:
    """Sequences of symbols from 1 on, each with a number; ``search`` asks for what lower-numbered sequences hold too."""

    def __init__(self, sequences: list[np.ndarray], numbers: np.ndarray):
        sizes = np.array([len(s) + 1 for s in sequences])
        self.begins = np.cumsum(sizes) - sizes
        ends = self.begins + sizes - 1
        text = np.zeros(int(sizes.sum()), np.int64)
        for begin, s in zip(self.begins.tolist(), sequences, strict=True):
            text[begin : begin + len(s)] = s
        self.text, self.lengths = text, sizes - 1
        sigma = int(text.max()) + 1
        order = suffix_order(text, ends)
        self.tree = WaveletTree(text[order - 1], sigma)
        self.base = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.numbers = np.unique(numbers, return_inverse=True)[1].astype(np.int32)
        # Least number of 1, 2, 4, ... suffixes in a row.
        self.least = [np.repeat(self.numbers, sizes)[order]]
        while 2 << (len(self.least) - 1) <= len(text):
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    def least_number(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least number among the suffixes of each interval (not empty)."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int32)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self.least[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return out

    def search(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, start) of windows of ``width`` symbols that a lower-numbered sequence holds, and that together cover all symbols of such windows.

        A window is read backwards until what was read stands in no lower-numbered sequence. All windows
        that hold this stretch are passed over. Behind a window that is found, the adjacent one is tried;
        if it fails, those between the two are tried from the last on, up to the first that is found.
        """
        n = np.array(self.lengths)
        mine = self.numbers
        at = np.flatnonzero(n >= width)  # the sequences still searched
        end = np.full(len(at), width)
        place, low, high = end.copy(), np.zeros(len(at), np.int64), np.full(len(at), len(self.text))
        mode = np.zeros(len(at), np.int8)  # 0: next in order, 1: adjacent to a found one, 2: between
        covered, far, failed_at = (np.zeros(len(at), np.int64) for _ in range(3))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            place = place - 1
            symbol = self.text[self.begins[at] + place]
            fresh = place + 1 == end
            base = self.base[symbol]
            low, high = np.where(fresh, base, low), np.where(fresh, self.base[symbol + 1], high)
            old = np.flatnonzero(~fresh)
            if len(old):
                both = self.tree.rank(np.tile(symbol[old], 2), np.concatenate([low[old], high[old]]))
                low[old], high[old] = base[old] + both[: len(old)], base[old] + both[len(old) :]
            alive = high - low > 1  # the sequence itself is in every interval
            some = np.flatnonzero(alive)
            alive[some] = self.least_number(low[some], high[some]) < mine[at[some]]
            whole = alive & (end - place == width)
            if whole.any():
                found.append((at[whole], place[whole]))
            size = n[at]
            # Found: next to it, or, if it lies between, behind the stretch that failed.
            go = whole & (mode < 2)
            between = whole & (mode == 2)
            covered = np.where(whole, end, covered)
            done = go & (end == size)
            new_end = np.where(go, np.minimum(end + width, size), np.where(between, failed_at + 1 + width, end))
            far = np.where(go, new_end, far)
            # Failed.
            lost = ~alive
            plain, adjacent, inner = lost & (mode == 0), lost & (mode == 1), lost & (mode == 2)
            failed_at = np.where(adjacent, place, failed_at)
            new_end = np.where(plain, place + 1 + width, np.where(adjacent, far - 1, np.where(inner, end - 1, new_end)))
            mode = np.where(go, 1, np.where(between, 0, np.where(adjacent, 2, mode))).astype(np.int8)
            passed = (adjacent | inner) & (new_end <= covered)
            new_end = np.where(passed, failed_at + 1 + width, new_end)
            mode[passed] = 0
            again = whole | lost
            place = np.where(again, new_end, place)
            end = new_end
            stay = ~done & (end <= size)
            if not stay.all():
                at, end, place, low, high, mode, covered, far, failed_at = (x[stay] for x in (at, end, place, low, high, mode, covered, far, failed_at))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
