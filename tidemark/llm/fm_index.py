"""A compressed FM-index over the words of one shard: backward search in wavelet matrices, and matching statistics.

What is kept of the sequences is the Burrows-Wheeler transform as a wavelet matrix (the
bits of a symbol for each word), the owner of each row as another one, and the common
prefix of neighbouring rows with its minima (two bytes a word). Sequences, suffix array
and its inverse are dropped once the index is built.

All steps work on arrays: many queries move one word to the left at a time.
"""

from __future__ import annotations

import numpy as np

#: Word with the lowest n bits set.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Ranks and counts over a sequence of symbols: a bit vector per bit of a symbol, 64 bits to a word with counts between."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        held = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((held >> level) & 1).astype(bool)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(np.int32(len(bit) - int(bit.sum())))
            held = np.concatenate([held[~bit], held[bit]])
        self.start = np.zeros(sigma, np.int32)
        self.start = self.rank(np.arange(sigma), np.zeros(sigma, np.int32))

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in [*self.words, *self.counts, self.start])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        place = at >> 6
        return self.counts[k][place] + np.bitwise_count(self.words[k][place] & _BELOW[at & 63])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each place."""
        at = at.astype(np.int32)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self._ones(k, at)
            at = np.where(symbol & (1 << level), self.zeros[k] + ones, at - ones)
        return at - self.start[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it comes before."""
        at, symbol = at.astype(np.int32), np.zeros(len(at), np.int32)
        for k in range(self.levels):
            bit = (self.words[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
            ones = self._ones(k, at)
            at = np.where(bit, self.zeros[k] + ones, at - ones)
            symbol = (symbol << 1) | bit
        return symbol, at - self.start[symbol]

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many symbols between low and high (not included) are less than each value."""
        n, at = len(low), np.concatenate([low, high]).astype(np.int32)
        total = np.zeros(n, np.int32)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self._ones(k, at)
            none = at - ones
            bit = (value & (1 << level)) != 0
            total += np.where(bit, none[n:] - none[:n], 0)
            at = np.where(np.concatenate([bit, bit]), self.zeros[k] + ones, none)
        return total


class FMIndex:
    """Of sequences of symbols from 1 on, each with an owner (0 to owners - 1). No match crosses the end of a sequence.

    Lengths are exact up to cap; a longer match counts as one of cap at least.
    """

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, cap: int):
        self.cap = cap
        sizes = np.array([len(s) + 1 for s in sequences], np.int64)
        text = np.zeros(int(sizes.sum()) + 1, np.int64)
        ends = np.cumsum(sizes)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = inside[-1] = False
        text[inside] = np.concatenate(sequences)
        self.sigma = sigma = int(text.max()) + 2
        text[-1] = sigma - 1  # comes once, so that all rotations differ
        self.rows = len(text)
        suffixes, classes = self._sorted(text, sigma)
        self.transform = WaveletMatrix(text[suffixes - 1], sigma)
        counts = np.bincount(text, minlength=sigma)
        self.first = (np.cumsum(counts) - counts).astype(np.int32)
        owner = np.append(np.repeat(owners, sizes), 0)
        self.most = int(owner.max()) + 1  # more than any owner
        self.owner = WaveletMatrix(owner[suffixes], self.most + 1)
        to_end = np.append(np.repeat(ends, sizes) - 1 - np.arange(len(text) - 1), 0)
        common = np.zeros(self.rows, np.int64)
        above, below = suffixes[:-1], suffixes[1:]
        at = np.zeros(self.rows - 1, np.int64)
        for length, of in reversed(classes):
            a, b = (np.minimum(x + at, self.rows - 1) for x in (above, below))
            at += np.where(of[a] == of[b], length, 0)
        common[1:] = np.minimum(np.minimum(at, cap), np.minimum(to_end[above], to_end[below]))
        #: Common prefix of each row with the one before, as leaves of a heap of minima; what lies beyond the last row has none.
        self.leaves = 1 << self.rows.bit_length()
        self.minima = np.zeros(2 * self.leaves, np.min_scalar_type(cap))
        self.minima[self.leaves : self.leaves + self.rows] = common
        step = self.leaves
        while step > 1:
            half = step // 2
            np.minimum(self.minima[step : 2 * step : 2], self.minima[step + 1 : 2 * step : 2], out=self.minima[half:step])
            step = half

    @property
    def nbytes(self) -> int:
        return self.transform.nbytes + self.owner.nbytes + self.minima.nbytes + self.first.nbytes

    @staticmethod
    def _sorted(text: np.ndarray, sigma: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffixes in order, by doubling the prefix that is compared; and per prefix length a number that equal prefixes share."""
        length, bits = 1, sigma.bit_length()
        classes = [(1, text)]
        while 2 * length * bits < 63:  # as many words as fit into one number need no sorting
            text = (text << (length * bits)) | np.roll(text, -length)
            length *= 2
            classes.append((length, text))
        order = np.argsort(text)
        while True:
            key = text[order]
            number = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            rank = np.empty(len(text), np.int64)
            rank[order] = number
            if number[-1] == len(text) - 1:
                return order, classes
            if classes[-1][0] == length:
                classes[-1] = (length, rank)
            else:
                classes.append((length, rank))
            text = rank * len(text) + np.roll(rank, -length)
            length *= 2
            order = np.argsort(text)

    def _before(self, row: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last row up to `row` whose common prefix is less than `least`."""
        node, live = row.astype(np.int64) + self.leaves, np.arange(len(row))
        while len(live := live[self.minima[node[live]] >= least[live]]):
            up = node[live]
            node[live] = up // (up & -up) - 1
        while len(live := np.flatnonzero(node < self.leaves)):
            child = 2 * node[live] + 1
            node[live] = child - (self.minima[child] >= least[live])
        return node - self.leaves

    def _after(self, row: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first row from `row` on whose common prefix is less than `least`."""
        node, live = row.astype(np.int64) + self.leaves, np.arange(len(row))
        while len(live := live[self.minima[node[live]] >= least[live]]):
            up = node[live] + 1
            node[live] = up // (up & -up)
        while len(live := np.flatnonzero(node < self.leaves)):
            child = 2 * node[live]
            node[live] = child + (self.minima[child] >= least[live])
        return node - self.leaves

    def _widened(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest interval of rows around each given one that share a shorter prefix, and that prefix's length."""
        size = np.maximum(self.minima[self.leaves + low], self.minima[self.leaves + high]).astype(np.int64)
        some = np.flatnonzero(size)
        wide_low, wide_high = np.zeros(len(low), np.int64), np.full(len(low), self.rows, np.int64)
        wide_low[some] = self._before(low[some], size[some])
        wide_high[some] = self._after(high[some], size[some])
        return wide_low, wide_high, size

    def statistics(self, queries: list[np.ndarray], owners: np.ndarray, least: int = 0) -> np.ndarray:
        """For the queries one after another: at each word, how many words from there on occur in sequences of a lesser owner than the query's (cap at most).

        A query moves to the left by backward search, as long as the interval of rows
        holds a lesser owner; if not, the interval is widened to a shorter prefix first.
        Words that the index doesn't have are symbol 0 or beyond its symbols. A query ends
        where no statistic of `least` can follow; the words before have 0 then.
        """
        sizes = np.array([len(q) for q in queries], np.int64)
        offsets = np.cumsum(sizes) - sizes
        flat = np.concatenate(queries) if queries else np.zeros(0, np.int64)
        flat = np.where((flat > 0) & (flat < self.sigma - 1), flat, 0)
        owners = np.minimum(owners, self.most)
        length = np.zeros(len(flat), np.int64)
        order = np.argsort(-sizes, kind="stable")
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), self.rows, np.int64)
        size = np.zeros(len(queries), np.int64)
        ended = np.zeros(len(queries), bool)
        for back in range(1, int(sizes.max(initial=0)) + 1):
            live = order[: np.searchsorted(-sizes[order], -back, "right")]
            live = live[~ended[live]]
            at = offsets[live] + sizes[live] - back
            symbol = flat[at]
            unknown = live[symbol == 0]
            low[unknown], high[unknown], size[unknown] = 0, self.rows, 0
            todo, symbol = live[symbol > 0], symbol[symbol > 0]
            while len(todo):
                n = len(todo)
                both = self.transform.rank(np.concatenate([symbol, symbol]), np.concatenate([low[todo], high[todo]]))
                a, b = self.first[symbol] + both[:n], self.first[symbol] + both[n:]
                ok = b > a
                some = np.flatnonzero(ok)
                ok[some] = self.owner.below(a[some], b[some], owners[todo[some]]) > 0
                on = todo[ok]
                low[on], high[on] = a[ok], b[ok]
                size[on] += 1
                go = ~ok & (size[todo] > 0)
                todo, symbol = todo[go], symbol[go]
                low[todo], high[todo], size[todo] = self._widened(low[todo], high[todo])
                # with this word and all those before it
                enough = size[todo] + 1 + sizes[todo] - back >= least
                ended[todo[~enough]] = True
                todo, symbol = todo[enough], symbol[enough]
            length[at] = np.where(ended[live], 0, np.minimum(size[live], self.cap))
            ended[live[size[live] + sizes[live] - back < least]] = True
        return length


class PhraseIndex:
    """Where phrases occur in sequences of symbols from 1 on, which stand one after another; none crosses the end of one.

    Kept are the transform as a wavelet matrix and one position in SAMPLE; the sequences are dropped.
    """

    SAMPLE = 32

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(len(symbols) + len(sizes) + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = inside[-1] = False
        names, text[inside] = np.unique(symbols, return_inverse=True)
        text[inside] += 1
        text[-1] = sigma = len(names) + 1  # comes once, so that all rotations differ
        suffixes = FMIndex._sorted(text, sigma + 1)[0]
        self.names, self.rows, self.ends = names, len(text), ends
        self.transform = WaveletMatrix(text[suffixes - 1], sigma + 1)
        counts = np.bincount(text, minlength=sigma + 1)
        self.first = np.cumsum(counts) - counts
        kept = suffixes % self.SAMPLE == 0
        self.kept = WaveletMatrix(kept.astype(np.int8), 2)
        self.positions = suffixes[kept].astype(np.int32)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.transform, self.kept, self.positions, self.names, self.first, self.ends))

    def intervals(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases (a row each) those that occur, and the rows [low, high) that begin with each: backward search, a symbol at a time."""
        place = np.minimum(np.searchsorted(self.names, phrases), len(self.names) - 1)
        live = np.flatnonzero((self.names[place] == phrases).all(axis=1))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.rows, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = place[live, k] + 1
            n = len(live)
            both = self.transform.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = self.first[symbol] + both[:n], self.first[symbol] + both[n:]
            some = high > low
            live, low, high = live[some], low[some], high[some]
        return live, low, high

    def located(self, row: np.ndarray) -> np.ndarray:
        """The position of each row: how many steps to the left it is from one that is kept."""
        out, todo, back = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(todo):
            is_kept, number = self.kept.access(row)
            there = is_kept == 1
            out[todo[there]] = self.positions[number[there]] + back
            todo, row = todo[~there], row[~there]
            symbol, before = self.transform.access(row)
            row, back = self.first[symbol] + before, back + 1
        return out

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place) of all occurrences; places count symbols alone, without the gaps between sequences."""
        phrase, low, high = self.intervals(phrases)
        n = high - low
        rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)
        at = self.located(rows)
        return np.repeat(phrase, n), at - np.searchsorted(self.ends, at)
