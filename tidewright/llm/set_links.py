"""Which of some sets of 64-bit tokens link: exact counts over an inverted index in numpy."""

from __future__ import annotations

import numpy as np


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the spans, one span after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class SetIndex:
    """Inverted index over sets (arrays of distinct tokens); tells which of them have percent of the union in common with a given set."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.sizes = percent, np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate([np.empty(0, np.int64), *sets])
        order = np.argsort(flat, kind="stable")
        self.members = np.repeat(np.arange(len(sets)), self.sizes)[order]
        flat = flat[order]
        self.starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
        self.lengths = np.diff(np.append(self.starts, len(flat)))
        self.union = flat[self.starts]

    def common(self, tokens: np.ndarray) -> np.ndarray:
        """Members in common with each set; nothing is counted if the union has too few of the tokens."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if len(at) * 100 < len(tokens) * self.percent:
            return np.zeros(len(self.sizes), dtype=np.int64)
        return np.bincount(self.members[_spans(self.starts[at], self.lengths[at])], minlength=len(self.sizes))

    def partners(self, tokens: np.ndarray) -> np.ndarray:
        """Numbers of the sets that link."""
        if not len(self.union):
            return np.empty(0, dtype=np.int64)
        k = self.common(tokens)
        return np.flatnonzero(k * 100 >= (self.sizes + len(tokens) - k) * self.percent)


class Stars:
    """Components of the link graph of some non-empty sets.

    Sets that no earlier one has linked are hubs and are counted against all sets. The others can only add links
    among themselves and between components: they're counted over the tokens that several components of them have.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.lead = np.arange(len(sets))

    def _join(self, a: int, others: np.ndarray) -> None:
        labels = np.unique(self.lead[np.append(others, a)])
        if len(labels) > 1:
            self.lead[np.isin(self.lead, labels)] = labels[0]

    def leaders(self) -> np.ndarray:
        """For each set the first one that it reaches by links, itself included."""
        n = len(self.sets)
        if n == 1:
            return self.lead
        if n == 2:
            a, b = self.sets
            k = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
            if k * 100 >= (len(a) + len(b) - k) * self.percent:
                self.lead[1] = 0
            return self.lead
        index, spokes = SetIndex(self.sets, self.percent), np.zeros(n, dtype=bool)
        for i in range(n):
            if not spokes[i]:
                found = index.partners(self.sets[i])
                spokes[found[found > i]] = True
                self._join(i, found)
        self._rest(np.flatnonzero(spokes))
        return self.lead

    def _rest(self, spokes: np.ndarray) -> None:
        if len(np.unique(self.lead[spokes])) < 2:
            return
        flat = np.concatenate([self.sets[i] for i in spokes])
        label = np.repeat(self.lead[spokes], [len(self.sets[i]) for i in spokes])
        order = np.lexsort((label, flat))
        flat, label = flat[order], label[order]
        same = flat[1:] == flat[:-1]
        several = np.unique(flat[1:][same & (label[1:] != label[:-1])])
        left = [i for i in spokes if np.isin(self.sets[i], several, assume_unique=True).sum() * 100 >= len(self.sets[i]) * self.percent]
        if len(left) < 2:
            return
        index, numbers = SetIndex([self.sets[i] for i in left], self.percent), np.array(left)
        for i in left:
            if len(np.unique(self.lead[numbers])) < 2:
                return
            self._join(i, numbers[index.partners(self.sets[i])])
