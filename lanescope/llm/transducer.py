"""Minimal acyclic transducer: words (bytes) to sequences of ids, with shared prefixes and suffixes.

Built directly in minimal form from sorted words: outputs move as far to the front as their common
prefixes allow, and a state is shared with an equal one as soon as no later word can change it.
The result is a handful of flat arrays in one file, which workers map into memory.
"""

from __future__ import annotations

import numpy as np

_MAGIC = 0x31544D4C            # format mark and version
_FIELDS = (("keys", np.int64), ("target", np.int32), ("arc_out", np.int32), ("final", np.int32),
           ("out_start", np.int32), ("out_len", np.int32), ("pool", np.int32))


class _Node:
    __slots__ = ("labels", "targets", "outs", "final")

    def __init__(self):
        self.labels, self.targets, self.outs, self.final = [], [], [], None


def compile_words(entries: list[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """entries: distinct non-empty words in ascending order with their ids."""
    register: dict = {}
    arcs: list[tuple[int, int, int, tuple]] = []
    finals: list = []
    path = [_Node()]

    def settle(node: _Node) -> int:
        key = (node.final, tuple(zip(node.labels, node.targets, node.outs)))
        state = register.get(key)
        if state is None:
            state = register[key] = len(finals)
            finals.append(node.final)
            arcs.extend((state, a, t, o) for a, t, o in key[1])
        return state

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            state = settle(path.pop())
            path[-1].targets[-1] = state

    last = b""
    for word, out in entries:
        if word <= last:
            raise ValueError("words must be distinct, not empty and in ascending order")
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        for depth in range(common):                 # what this word does not share moves one state on
            here, below = path[depth], path[depth + 1]
            old = here.outs[-1]
            k = 0
            while k < min(len(old), len(out)) and old[k] == out[k]:
                k += 1
            here.outs[-1], rest, out = old[:k], old[k:], out[k:]
            if rest:
                below.outs = [rest + o for o in below.outs]
                if below.final is not None:
                    below.final = rest + below.final
        for byte in word[common:]:
            node = path[-1]
            node.labels.append(byte)
            node.targets.append(-1)
            node.outs.append(())
            path.append(_Node())
        path[-1].final = ()
        path[common].outs[-1] = out
        last = word
    close(0)
    root = settle(path[0])

    outputs: dict[tuple, int] = {(): 0}
    number = lambda o: outputs.setdefault(o, len(outputs))
    arcs.sort(key=lambda a: (a[0], a[1]))
    got = {"keys": [s * 256 + a for s, a, _, _ in arcs], "target": [t for _, _, t, _ in arcs],
           "arc_out": [number(o) for _, _, _, o in arcs],
           "final": [-1 if f is None else number(f) for f in finals]}
    got["out_len"] = [len(o) for o in outputs]
    got["out_start"] = list(np.cumsum([0, *got["out_len"][:-1]]))
    got["pool"] = [i for o in outputs for i in o]
    arrays = [np.array(got[name], kind) for name, kind in _FIELDS]
    head = np.array([_MAGIC, root, *(len(a) for a in arrays)], np.int64)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


class Transducer:
    """Lookups of many words at once over a compiled file, mapped into memory."""

    def __init__(self, file: str | bytes):
        raw = np.frombuffer(file, np.uint8) if isinstance(file, bytes) else np.memmap(file, np.uint8, "r")
        head = raw[:8 * (2 + len(_FIELDS))].view(np.int64)
        if head[0] != _MAGIC:
            raise ValueError("not a compiled lexicon")
        self.root, at = int(head[1]), head.nbytes
        for (name, kind), n in zip(_FIELDS, head[2:].tolist(), strict=True):
            setattr(self, name, raw[at:at + n * np.dtype(kind).itemsize].view(kind)) if at % np.dtype(kind).itemsize == 0 \
                else setattr(self, name, np.frombuffer(raw[at:at + n * np.dtype(kind).itemsize].tobytes(), kind))
            at += n * np.dtype(kind).itemsize

    def lookup(self, words: list[bytes]) -> list:
        """The ids of each word as an array; None for words that are not in the lexicon."""
        if not words or not len(self.keys):
            return [None] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(lens) - lens
        state = np.full(len(words), self.root, np.int64)
        alive, step, steps = np.flatnonzero(lens > 0), 0, []
        while len(alive):
            key = state[alive] * 256 + data[starts[alive] + step]
            arc = np.searchsorted(self.keys, key)
            hit = self.keys[np.minimum(arc, len(self.keys) - 1)] == key
            state[alive[~hit]] = -1
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.target[arc]
            out = self.arc_out[arc]
            steps.append((alive[out > 0], out[out > 0]))
            step += 1
            alive = alive[lens[alive] > step]
        ends = np.where(state >= 0, self.final[np.maximum(state, 0)], -1)
        ends[lens == 0] = -1
        steps.append((np.flatnonzero(ends > 0), ends[ends > 0]))
        who, out = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(who, kind="stable")
        who, out = who[order], out[order]
        n = self.out_len[out].astype(np.int64)
        first = np.cumsum(n) - n
        ids = self.pool[np.repeat(self.out_start[out] - first, n) + np.arange(n.sum())]
        total = np.cumsum(np.bincount(who, weights=n, minlength=len(words)).astype(np.int64))
        cut = np.r_[0, total].tolist()
        return [ids[a:b] if f >= 0 else None for a, b, f in zip(cut, cut[1:], ends.tolist())]
