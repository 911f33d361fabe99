"""Exact and fast encoding of texts with a BPE tokenizer file.

A text is cut at white space, where no pre-token of these tokenizers can cross; each distinct
piece is encoded once per worker and remembered, so that the running text costs one dictionary
lookup a piece. Unknown pieces go to the ``tokenizers`` library: to its merge model, word by
word, where the piece holds only characters whose classes are beyond doubt, else to its whole
pipeline. The remembered pieces are bounded; those met once are forgotten first.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np

from .merges import Merger

#: The split patterns of the two tokenizer files, as far as one piece needs them.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Letters, digits and marks on which every Unicode version and library agrees, with a plain
#: lower case and in normal form: ASCII and Latin-1, Latin Extended-A without its special cases.
_PLAIN = re.compile("[\x20-\x7e\xa1-\xac\xae-\xffĀ-įĴ-ňŊ-ž\n\t]*")
#: White space on which the libraries may differ.
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
#: Longer pieces are encoded each time instead of being remembered.
LONGEST = 48


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + len(chars) - len(printable))
    return [chars[b] for b in range(256)]


def gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of values[start:start + len]."""
    ends = np.cumsum(lens)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1])]


class _Slots(dict):
    """piece -> slot; a new piece gets the next slot and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.count, self.new = 0, []

    def __missing__(self, piece: str) -> int:
        slot = self.count
        self.count += 1
        self.new.append(piece)
        if len(piece) <= LONGEST:
            self[piece] = slot
        return slot


class PieceEncoder:
    """``encode(texts)`` gives the ids of each text as a numpy array of int32, exactly as the
    library does with ``add_special_tokens=False``, truncation and padding unused.

    lookup: may give the ids of words known beforehand (None: unknown), for many words at once.
    """

    def __init__(self, tokenizer_json: str, limit: int = 600_000,
                 lookup: Callable[[list[str]], list] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks are the parallelism
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(tokenizer_json)
        self.lower = spec.get("normalizer") is not None   # words: lower case, white space dropped
        self.words = regex.compile(WORD_PATTERN if self.lower else BYTE_PATTERN).findall
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.chars = dict(enumerate(byte_chars()))
        self.lookup, self.limit = lookup, limit
        self.merger = Merger(spec["model"], byte_chars())
        self._forget_all()

    def _forget_all(self) -> None:
        self.slots, self.known = _Slots(), _Slots()
        self.flat, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.word_ids, self.word_starts, self.word_lens = self.flat, self.starts, self.lens
        self.open = np.zeros(0, bool)                     # the piece ends in white space
        self.hits = np.zeros(0, np.int64)

    # -- words and pieces ------------------------------------------------------------------

    def split(self, piece: str) -> list[str] | None:
        """The pre-tokens of a piece; None where only the library's own pipeline is certain."""
        if not _PLAIN.fullmatch(piece):
            return None
        return self.words(piece.lower() if self.lower else piece)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _long(self, word: str) -> list[int]:
        chars = word.encode().decode("latin-1").translate(self.chars)
        return [t.id for t in self.tokenizer.model.tokenize(chars)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids each). A key that begins with a zero character
        is a piece for the library's whole pipeline, any other a pre-token."""
        out: list = [None] * len(words)
        plain = []
        for i, w in enumerate(words):
            if w[0] == "\0":
                out[i] = self.whole(w[1:])
            else:
                plain.append(i)
        if self.lookup:
            for i, ids in zip(plain, self.lookup([words[i] for i in plain]), strict=True):
                out[i] = ids
            plain = [i for i in plain if out[i] is None]
        raw = [words[i].encode() for i in plain]
        short = [k for k, w in enumerate(raw) if len(w) <= Merger.LONGEST]
        ids, n = self.merger.merge([raw[k] for k in short])
        if len(short) == len(words):
            return ids, n
        ends = np.cumsum(n)
        for k, e, m in zip(short, ends.tolist(), n.tolist(), strict=True):
            out[plain[k]] = ids[e - m:e]
        for i in plain:
            if out[i] is None:
                out[i] = self._long(words[i])
        return (np.concatenate([np.asarray(x, np.int32) for x in out]) if out else ids), np.fromiter(map(len, out), np.int64, len(out))

    def _split_new(self) -> tuple[list[str], list[int], list[bool]]:
        """The pre-tokens of the pieces that wait, how many each has, whether it ends in white space.
        A piece of letters, or of letters and a comma or full stop, needs no pattern."""
        new, lead = self.slots.new, "" if self.lower else " "
        plain, words, n, is_open = _PLAIN.fullmatch("".join(new)) is not None, [], [1] * len(new), [False] * len(new)
        for i, key in enumerate(new):
            body = key[:-1] if key[-1:] in (",", ".") else key
            if body.isalpha() and (plain or body.isascii()):
                words.append(lead + (body.lower() if self.lower else body))
                if body is not key:
                    words.append(key[-1])
                    n[i] = 2
            else:
                raw = self.raw(key)
                some = self.split(raw)
                some = ["\0" + raw] if some is None else some
                words += some
                n[i], is_open[i] = len(some), raw[-1:].isspace()
        return words, n, is_open

    def _fill(self) -> None:
        """Encode the pieces that wait, through their words."""
        if not self.slots.new:
            return
        words, n, is_open = self._split_new()
        n = np.array(n, np.int64)
        slots = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ids, lens = self.encode_words(self.known.new)
        self.known.new = []
        self.word_starts = np.r_[self.word_starts, len(self.word_ids) + np.cumsum(lens) - lens]
        self.word_lens = np.r_[self.word_lens, lens]
        self.word_ids = np.r_[self.word_ids, ids]
        per_word = self.word_lens[slots]
        flat = gather(self.word_ids, self.word_starts[slots], per_word)
        total = np.r_[0, np.cumsum(per_word)]
        lens = np.diff(total[np.r_[0, np.cumsum(n)]])
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lens) - lens]
        self.lens = np.r_[self.lens, lens]
        self.flat = np.r_[self.flat, flat]
        self.open = np.r_[self.open, np.array(is_open, bool)]
        self.slots.new = []

    # -- texts -----------------------------------------------------------------------------

    def raw(self, key: str) -> str:
        """The piece that a slot key stands for."""
        return key if self.lower else key[1:] if key[:1] == " " else " " + key

    def _pieces(self, text: str) -> list[str]:
        """Slot keys of a text without special tokens and odd white space."""
        if self.lower:
            return text.split()
        pieces = text.split(" ")
        if pieces[0] == "":
            return pieces[1:]                # the text is empty or begins with a space
        pieces[0] = " " + pieces[0]          # without a space before it: a key of its own
        return pieces

    def _closed(self, text: str) -> list[int]:
        """Byte-level ids of a text with runs of white space: cut only where such a run begins."""
        words: list[str] = []
        for unit in re.split(r"(?<=\S)(?= )", text):
            words += self.split(unit) or ["\0" + unit]
        return self.encode_words(words)[0]

    def _segments(self, text: str) -> list[tuple[str, int]]:
        """(text, -1) and ("", id of a special token), in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return [(text, -1)]
        return [("", self.special[s]) if s in self.special else (s, -1) for s in self.cut.split(text)]

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        if self.slots.count > self.limit:
            self._forget()
        runs: list = []                 # per segment: its slots, or its ids if they need no slots
        texts_of: list[str] = []
        owner: list[int] = []           # the text that a run belongs to
        count = 0
        for number, text in enumerate(texts):
            count += 1
            for segment, special in self._segments(text or ""):
                if special >= 0:
                    run = [special]
                elif not segment:
                    continue
                elif _ODD_SPACE.search(segment):
                    run = self.whole(segment)
                else:
                    keys = self._pieces(segment)
                    run = np.fromiter(map(self.slots.__getitem__, keys), np.int32, len(keys))
                runs.append(run)
                texts_of.append(segment)
                owner.append(number)
        self._fill()
        self.hits = np.r_[self.hits, np.zeros(self.slots.count - len(self.hits), np.int64)]
        slotted = [k for k, run in enumerate(runs) if isinstance(run, np.ndarray)]
        slots = np.concatenate([runs[k] for k in slotted]) if slotted else np.zeros(0, np.int32)
        self.hits += np.bincount(slots, minlength=len(self.hits))
        n = self.lens[slots]
        ids = gather(self.flat, self.starts[slots], n)
        piece_ends = np.cumsum([len(runs[k]) for k in slotted]) if slotted else []
        total = np.r_[0, np.cumsum(n)]
        is_open = None if self.lower else self.open[slots]
        for k, end in zip(slotted, piece_ends):
            begin = end - len(runs[k])
            if is_open is not None and is_open[begin:end - 1].any():
                runs[k] = self._closed(texts_of[k])
            else:
                runs[k] = ids[total[begin]:total[end]]
        out: list = [None] * count
        for number, run in zip(owner, runs):
            run = np.asarray(run, np.int32)
            out[number] = run if out[number] is None else np.concatenate([out[number], run])
        return [np.zeros(0, np.int32) if x is None else x for x in out]

    def _forget(self) -> None:
        """Keep the pieces met more than once, or nothing if those are most."""
        keep = [p for p, s in self.slots.items() if self.hits[s] > 1]
        slots, flat, starts, lens, is_open = self.slots, self.flat, self.starts, self.lens, self.open
        self._forget_all()
        if not keep or len(keep) > self.limit // 2:
            return
        old = np.fromiter(map(slots.__getitem__, keep), np.int64, len(keep))
        self.slots.update(zip(keep, range(len(keep))))
        self.slots.count = len(keep)
        self.flat, self.lens, self.open = gather(flat, starts[old], lens[old]), lens[old], is_open[old]
        self.starts, self.hits = np.cumsum(self.lens) - self.lens, np.zeros(len(keep), np.int64)


_CACHE: dict = {}


def worker_encoder(tokenizer_json: str, key: str = "", **kw) -> PieceEncoder:
    """One encoder per worker process and file, kept between its tasks."""
    k = (hash(tokenizer_json), key)
    if k not in _CACHE:
        _CACHE.clear()
        _CACHE[k] = PieceEncoder(tokenizer_json, **kw)
    return _CACHE[k]
