"""Byte-pair merges of many words at once, in numpy.

All words advance together: in each step every unfinished word makes the one merge that the
algorithm prescribes (lowest rank, leftmost), and only the pairs beside a merge are looked up
again. The result is that of merging each word by itself.
"""

from __future__ import annotations

import numpy as np

_NONE = np.int64(1 << 40)          # the rank of a pair that never merges
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> (rank, merged id): an open-addressing table over numpy arrays."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        bits = max(4, int(2 * len(pairs) + 1).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.value = np.full(1 << bits, _NONE, np.int64)
        self.merged = merged.astype(np.int32)
        keys = (pairs[:, 0].astype(np.int64) << 32) | pairs[:, 1]
        at, todo = self._first(keys), np.arange(len(keys))
        while len(todo):                            # place one key per free cell, the rest move on
            free = self.keys[at[todo]] == -1
            cells, who = np.unique(at[todo][free], return_index=True)
            placed = todo[free][who]
            self.keys[cells], self.value[cells] = keys[placed], placed
            todo = np.setdiff1d(todo, placed)
            at[todo] = (at[todo] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = self._first(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.value[at], _NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.value[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class Merger:
    """Merges of one vocabulary. spec: the parsed ``model`` part of a tokenizer file."""

    #: Longer words would make many steps for few others; the caller merges them on its own.
    LONGEST = 64

    def __init__(self, model: dict, byte_chars: list[str]):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, (list, tuple)) else tuple(m.split(" ")) for m in model["merges"]]
        self.table = PairTable(np.array([(vocab[a], vocab[b]) for a, b in pairs], np.int64).reshape(-1, 2),
                               np.array([vocab[a + b] for a, b in pairs], np.int32))
        self.inner = np.array([vocab.get(c, -1) for c in byte_chars], np.int32)
        self.last = np.array([vocab.get(c + suffix, -1) for c in byte_chars], np.int32)
        if min(self.inner.min(), self.last.min()) < 0:
            raise ValueError("the vocabulary lacks a byte")

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each). Words are not empty."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        n = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(n)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        who = np.repeat(np.arange(len(words)), n)
        rank = np.full(len(sym), _NONE, np.int64)
        inside = np.flatnonzero(who[:-1] == who[1:])
        rank[inside] = self.table.ranks(sym[inside], sym[inside + 1])
        done_sym, done_who = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            best = np.minimum.reduceat(rank, starts)
            best = np.repeat(best, np.diff(np.r_[starts, len(sym)]))
            ended = best == _NONE
            if ended.any():
                done_sym.append(sym[ended])
                done_who.append(who[ended])
                go = ~ended
                sym, who, rank, best = sym[go], who[go], rank[go], best[go]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.r_[True, who[at[1:]] != who[at[:-1]]]]      # the leftmost of each word
            sym[at] = self.table.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, who, rank = sym[keep], who[keep], rank[keep]
            at -= np.arange(len(at))
            self._again(sym, who, rank, at)
            self._again(sym, who, rank, at[at > 0] - 1)
        all_sym, all_who = np.concatenate(done_sym), np.concatenate(done_who)
        order = np.argsort(all_who, kind="stable")
        return all_sym[order], np.bincount(all_who, minlength=len(words))

    def _again(self, sym, who, rank, at) -> None:
        rank[at] = _NONE
        pair = at[at + 1 < len(sym)]
        pair = pair[who[pair] == who[pair + 1]]
        rank[pair] = self.table.ranks(sym[pair], sym[pair + 1])
