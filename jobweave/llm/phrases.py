"""Phrases of evaluation items as tries of reversed phrases, and their search in an FM-index.

A block of items is kept as its tokens and the sorted order of its phrases. Backward search
reads phrases from their ends, so phrases that end alike share their first steps: the search
walks a trie level by level and leaves a branch as soon as the text does not hold it. Its work
is bounded by what the text holds, not by the number of phrases.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

from jobweave.llm.fm_index import FMIndex

PHRASE_LATIN, PHRASE_OTHER = 14, 6
_HAN = re.compile(r"[一-鿿㐀-䶿]")


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``starts`` and are ``counts`` long, one after another."""
    return np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())


@dataclass
class Group:
    """Phrases of one length: the item and place of each of their occurrences in items, sorted by reversed phrase."""

    length: int
    item: np.ndarray
    place: np.ndarray
    codes: np.ndarray  # of all letters of the items that have phrases of this length
    at: np.ndarray  # where each sorted phrase begins in ``codes``
    levels: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    owners: np.ndarray | None = None

    def grow(self) -> None:
        """The trie: of each level the letter of every node and where its children begin on the next one."""
        new = np.zeros(len(self.at), bool)
        new[:1] = True
        starts = []
        for level in range(self.length):
            letter = self.codes[self.at + (self.length - 1 - level)]
            new[1:] |= letter[1:] != letter[:-1]
            start = np.flatnonzero(new)
            if starts:
                self.levels[-1] = (self.levels[-1][0], np.searchsorted(start, np.r_[starts[-1], len(self.at)]))
            self.levels.append((letter[start], np.empty(0, np.int64)))
            starts.append(start)
        self.owners = np.r_[starts[-1], len(self.at)]

    def search(self, index: FMIndex, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase number, low, high): the phrases that the indexed text holds and their row ranges."""
        node = np.arange(len(self.levels[0][0]))
        low, high = np.zeros(len(node), np.int64), np.full(len(node), index.length, np.int64)
        for level, (letter, children) in enumerate(self.levels):
            code = np.minimum(np.searchsorted(alphabet, letter[node]), len(alphabet) - 1)
            known = alphabet[code] == letter[node]
            node, code = node[known], code[known] + 1
            low, high = index.step(code, low[known], high[known])
            held = high > low
            node, low, high = node[held], low[held], high[held]
            if level + 1 < self.length:
                first = children[node]
                count = children[node + 1] - first
                node, low, high = ranges(first, count), np.repeat(low, count), np.repeat(high, count)
        return node, low, high


class Phrases:
    """All phrases of a block of items, and the items' tokens."""

    def __init__(self, ids: list[int], tokens: list[list[str]]):
        self.ids, self.tokens = ids, tokens
        letters = ["".join(t) for t in tokens]
        self.size = np.array([len(x) for x in letters], np.int64)
        self.phrase = np.array([min(len(x), PHRASE_OTHER if _HAN.search(x) else PHRASE_LATIN) for x in letters], np.int64)
        self.groups: list[Group] = []
        for length in np.unique(self.phrase[self.phrase > 0]).tolist():
            items = np.flatnonzero(self.phrase == length)
            codes = codes_of("".join(letters[k] for k in items))
            begin = np.r_[0, np.cumsum(self.size[items])[:-1]]
            many = self.size[items] - length + 1
            at, item = ranges(begin, many), np.repeat(items, many)
            order = np.lexsort([codes[at + k] for k in range(length)])
            self.groups.append(Group(length, item[order], (at - np.repeat(begin, many))[order], codes, at[order]))

    def ready(self) -> Phrases:
        """The tries and the numbers of the items' tokens, made once per worker."""
        for g in self.groups:
            if not g.levels:
                g.grow()
        if not hasattr(self, "number"):
            self.number: dict[str, int] = {}
            self.flat = np.array([self.number.setdefault(t, len(self.number)) for tokens in self.tokens for t in tokens], np.int64)
            self.count = np.array([len(t) for t in self.tokens], np.int64)
            self.edge = np.r_[0, np.cumsum(self.count)]
        return self

    def known_in(self, items: np.ndarray, tokens: list[str]) -> np.ndarray:
        """Of each of ``items`` how many of its tokens are among ``tokens``: no passage within can hold more of them."""
        present = np.zeros(len(self.number), np.int64)
        present[[self.number[t] for t in set(tokens) if t in self.number]] = 1
        rows = ranges(self.edge[items], self.count[items])
        return np.add.reduceat(present[self.flat[rows]], np.r_[0, np.cumsum(self.count[items])[:-1]])
