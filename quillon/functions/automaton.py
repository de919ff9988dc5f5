"""Phrases in texts by one pass over their words."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Bytes of texts that are split into words together, unless one text is longer.
FOUND_BYTES = 1 << 20


class PhraseAutomaton:
    """All of many phrases (words with single spaces) in a text at once: a trie over words with a link from each state to its longest proper suffix."""

    def __init__(self, phrases: list[str]):
        self.phrases = list(dict.fromkeys(phrases))
        split = [p.split(" ") for p in self.phrases]
        self.words = sorted({w for ws in split for w in ws})
        number = {w: i for i, w in enumerate(self.words)}
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for no, ws in enumerate(split):
            at = 0
            for w in ws:
                at = self.next[at].setdefault(number[w], len(self.next))
                if at == len(self.next):
                    self.next.append({})
                    self.ends.append([])
            self.ends[at].append(no)
        self.back = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            for w, to in self.next[at].items():
                queue.append(to)
                up = self.back[at]
                while up and w not in self.next[up]:
                    up = self.back[up]
                self.back[to] = self.next[up].get(w, 0)
                self.ends[to] = self.ends[to] + self.ends[self.back[to]]

    def find(self, texts: pa.Array, most: int = FOUND_BYTES) -> list[set[int]]:
        """The numbers of the phrases in each text, as whole words; null has none. Texts are split into words `most` bytes at a time."""
        found, begin, size = [], 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            if size and size + n > most:
                found += self._find(texts.slice(begin, i - begin))
                begin, size = i, 0
            size += n
        return found + self._find(texts.slice(begin))

    def _find(self, texts: pa.Array) -> list[set[int]]:
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        size = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        word = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=pa.array(self.words, pa.string())), -1))
        found: list[set[int]] = [set() for _ in range(len(size))]
        # only words that some phrase has are walked; the others, and ends of texts, lead back to the start
        known = np.flatnonzero(word >= 0)
        text = np.repeat(np.arange(len(size)), size)[known]
        fresh = np.ones(len(known), bool)
        fresh[1:] = (np.diff(known) > 1) | (np.diff(text) > 0)
        at, following, back, ends = 0, self.next, self.back, self.ends
        for w, t, new in zip(word[known].tolist(), text.tolist(), fresh.tolist(), strict=True):
            if new:
                at = 0
            while at and w not in following[at]:
                at = back[at]
            at = following[at].get(w, 0)
            if ends[at]:
                found[t].update(ends[at])
        return found
