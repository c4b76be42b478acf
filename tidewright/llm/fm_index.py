"""Compressed FM-index over word sequences: run-length Burrows-Wheeler transform with a wavelet matrix over its run heads, sampled documents, and matching statistics of many patterns at once by backward search."""

from __future__ import annotations

import numpy as np

_SIX, _LOW = np.int64(6), np.uint64(63)
#: Every so many words of a piece the index knows the piece; from other rows it walks there.
SAMPLE = 4


class Bits:
    """Bit vector packed into 64-bit words with a running count in front of each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        padded = np.zeros((len(bits) // 64 + 1) * 8, dtype=np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each position."""
        word = at >> _SIX
        below = (np.uint64(1) << (at.astype(np.uint64) & _LOW)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)

    def test(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> _SIX] >> (at.astype(np.uint64) & _LOW)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels, self.zeros, bits = [], [], max(1, int(top).bit_length())
        self.shifts = list(range(bits - 1, -1, -1))
        row = symbols
        for s in self.shifts:
            one = ((row >> s) & 1).astype(bool)
            self.levels.append(Bits(one))
            self.zeros.append(int(len(row) - one.sum()))
            row = np.concatenate([row[~one], row[one]])
        every = np.arange(top + 1, dtype=np.int64)
        self.start = self._down(every, np.zeros(top + 1, dtype=np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for s, level, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            ones = level.rank1(at)
            at = np.where((symbols >> s) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in front of its position."""
        return self._down(symbols, at) - self.start[symbols]


class RunLengthRanks:
    """Ranks and members of a sequence of which only the runs of equal symbols are kept; repeated passages make few runs."""

    def __init__(self, row: np.ndarray, top: int):
        changes = np.ones(len(row), dtype=bool)
        changes[1:] = row[1:] != row[:-1]
        starts = np.flatnonzero(changes)
        self.starts, self.heads = starts.astype(np.int32), row[starts].astype(np.int32)
        order = np.argsort(self.heads, kind="stable")
        lengths = np.diff(np.append(starts, len(row)))[order]
        self.total = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        self.first = np.searchsorted(self.heads[order], np.arange(top + 1)).astype(np.int32)
        self.tree = WaveletMatrix(self.heads.astype(np.int64), top)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in front of its position."""
        run = np.maximum(np.searchsorted(self.starts, at, side="right") - 1, 0)
        base = self.first[symbols].astype(np.int64)
        whole = self.total[base + self.tree.rank(symbols, run)].astype(np.int64) - self.total[base]
        return whole + np.where(self.heads[run] == symbols, at - self.starts[run], 0)

    def member(self, at: np.ndarray) -> np.ndarray:
        return self.heads[np.searchsorted(self.starts, at, side="right") - 1].astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs, in order."""
    return np.unique(a * np.int64(int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)


def _triples(r: np.ndarray, k: int) -> np.ndarray:
    """Dense ranks of r and what stands k and 2 k further on, in order."""
    top = np.int64(int(r.max(initial=0)) + 2)
    return np.unique((r * top + _shifted(r, k)) * top + _shifted(r, 2 * k), return_inverse=True)[1].astype(np.int64)


def _shifted(r: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(r)
    if k < len(r):
        out[:-k] = r[k:] + 1
    return out


class FMIndex:
    """Index of pieces (arrays of 64-bit word hashes), each with a number (a document's). Tells which patterns of up to `window` words it has, and in which pieces.

    Kept: the run-length transform, the counts of smaller symbols, where blocks of suffixes with window - 1 words in
    common begin, and the piece of every SAMPLE-th word. The suffix order is only needed to build these.
    """

    def __init__(self, pieces: list[np.ndarray], numbers: np.ndarray, window: int):
        self.window, self.numbers = window, np.asarray(numbers, dtype=np.int64)
        words = np.concatenate([*pieces, np.empty(0, np.uint64)])
        self.alphabet, dense = np.unique(words, return_inverse=True)
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        ends = np.cumsum(lengths + 1)
        self.n = int(ends[-1]) if len(ends) else 0
        text, inside = np.zeros(self.n, dtype=np.int64), np.ones(self.n, dtype=bool)
        inside[ends - 1] = False
        text[inside] = dense + 1
        # Each end of a piece sorts in front of all words and by itself, so suffixes differ within their pieces.
        rank = np.zeros(self.n, dtype=np.int64)
        rank[~inside], rank[inside] = np.arange(len(pieces)), dense + len(pieces)
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        depth, longest, common = 1, int(lengths.max(initial=0)) + 1, {1: rank}
        while depth < longest and (not self.n or int(rank.max()) + 1 < self.n):
            # Three ranks fit one number, as an index has far less than two million words.
            wide = self.n < 2_000_000
            rank, depth = (_triples(rank, depth), depth * 3) if wide else (_pairs(rank, _shifted(rank, depth)), depth * 2)
            if depth < window:
                common[depth] = rank
        order = np.argsort(rank, kind="stable")
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        self.bwt = RunLengthRanks(text[order - 1], len(self.alphabet))
        # Blocks of suffixes whose first window - 1 words are equal, from overlapping parts.
        half = max((d for d in common if d <= window - 1), default=0)
        block, got = (common[half], half) if half else (np.zeros(self.n, np.int64), window - 1)
        while got < window - 1:
            more = min(half, window - 1 - got)
            block, got = _pairs(block, _shifted(common[half], got + more - half)), got + more
        block = block[order]
        self.blocks = np.flatnonzero(np.diff(np.concatenate([[-1], block]))).astype(np.int32)
        offset = np.arange(self.n) - np.repeat(ends - lengths - 1, lengths + 1)
        known = (offset % SAMPLE == 0)[order]
        self.known = Bits(known)
        self.samples = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths + 1)[order][known]
        # Where the last window - 1 words of each piece stand in the order.
        self.tails = rank[ends - np.minimum(lengths, window - 1) - 1]

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of the patterns."""
        both = np.tile(self.counts[symbols], 2) + self.bwt.rank(np.tile(symbols, 2), np.concatenate([low, high]))
        return both[: len(symbols)], both[len(symbols) :]

    def shortened(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first window - 1 words of the suffixes in these rows."""
        at = np.searchsorted(self.blocks, low, side="right") - 1
        ends = np.append(self.blocks[1:], self.n)
        return self.blocks[at].astype(np.int64), ends[at].astype(np.int64)

    def coded(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for those that the index doesn't have."""
        at = np.searchsorted(self.alphabet, words)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == words, at + 1, 0) if len(self.alphabet) else np.zeros(len(words), np.int64)

    def pieces_of(self, rows: np.ndarray) -> np.ndarray:
        """The piece in which the suffix of each row starts: walks backwards to the next sample."""
        out, left, at = np.empty(len(rows), dtype=np.int64), np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            there = self.known.test(at)
            out[left[there]] = self.samples[self.known.rank1(at[there])]
            left, at = left[~there], at[~there]
            symbols = self.bwt.member(at)
            at = self.counts[symbols] + self.bwt.rank(symbols, at)
        return out

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least number among the pieces of each interval; equal intervals are walked once."""
        first, where = np.unique(low, return_index=True)
        sizes, back = high[where] - first, np.searchsorted(first, low)
        ends = np.cumsum(sizes)
        rows = np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.minimum.reduceat(self.numbers[self.pieces_of(rows)], ends - sizes)[back] if len(rows) else np.empty(0, np.int64)

    def intervals(self, patterns: list[np.ndarray], own: bool = False) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Matching statistics: for each pattern and position, how many words from there on match somewhere (window at most), and the rows low to high of that match.

        Patterns are read backwards side by side. A match of window words is cut to window - 1 before the next word is
        put in front. Where a word can't be put in front, the match loses its last word and is searched again from its
        new end: no longer match can start there or further left. own: the patterns are the index's pieces, whose last
        window - 1 words match to the end and are kept as rows; their search starts there, and rows aren't told for them.
        """
        lengths = np.array([len(p) for p in patterns], dtype=np.int64)
        flat = self.coded(np.concatenate([*patterns, np.empty(0, np.uint64)]))
        ends = np.cumsum(lengths)
        begin = ends - lengths
        got, first, last = (np.zeros(len(flat), dtype=np.int64) for _ in range(3))
        # For each pattern: the position in question, the end of the match tried, and the word to put in front next.
        at, end = ends - 1, ends - 1
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        if own and len(patterns):
            got[:] = np.minimum(np.repeat(ends, lengths) - np.arange(len(flat)), self.window - 1)
            long = np.flatnonzero(lengths >= self.window)
            at = np.where(lengths >= self.window, ends - self.window, begin - 1)
            low[long], high[long] = self.shortened(self.tails[long]) if self.window > 1 else (low[long], high[long])
        word = at.copy()
        live = np.flatnonzero(at >= begin)
        while len(live):
            c = flat[word[live]]
            x, y = self.step(c, low[live], high[live])
            ok = (x < y) & (c > 0)
            low[live], high[live] = np.where(ok, x, 0), np.where(ok, y, self.n)
            done = live[ok & (word[live] == at[live])]
            word[live[ok]] -= 1
            got[at[done]], first[at[done]], last[at[done]] = end[done] - at[done] + 1, low[done], high[done]
            at[done] -= 1
            long = done[end[done] - at[done] + 1 > self.window]
            if len(long):
                low[long], high[long] = self.shortened(low[long])
                end[long] -= 1
                empty = long[end[long] <= at[long]]
                low[empty], high[empty] = 0, self.n
            failed = live[~ok]
            if len(failed):
                # No match can hold a word that the index hasn't: the next ends in front of it.
                end[failed] = np.where(c[~ok] == 0, word[failed] - 1, end[failed] - 1)
                at[failed] = np.minimum(at[failed], end[failed])
                word[failed] = end[failed]
            live = live[at[live] >= begin[live]]
        cut = [slice(i, j) for i, j in zip(begin, ends, strict=True)]
        return [got[s] for s in cut], [first[s] for s in cut], [last[s] for s in cut]

    def statistics(self, patterns: list[np.ndarray], own: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The lengths of intervals(), and for each pattern and position the least number of a piece where the window from there on starts; -1 where it starts nowhere."""
        lengths, low, high = self.intervals(patterns, own)
        got, first, last = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (lengths, low, high))
        out = np.full(len(got), -1, dtype=np.int64)
        whole = got >= self.window
        out[whole] = self.least(first[whole], last[whole])
        return lengths, np.split(out, np.cumsum([len(p) for p in patterns])[:-1]) if patterns else []
