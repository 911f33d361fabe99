"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes its normalised form (a space turns into the piece sign, one more goes before the text)
and is cut into words where no piece of the vocabulary can cross: before a run of piece signs and
around line feeds, if the vocabulary allows it. New words of a batch are merged together in flat numpy
arrays of symbols: every round finds the best score of each segment, merges all its occurrences from
the left that the library's agenda would take one after another, and compacts the arrays, until no
pair remains. A segment ends where two characters stand together in no piece. Words met before are
remembered. Decoding gathers the bytes of the pieces.

The vocabulary is read through the sentencepiece library, which does none of the encoding.

Defined results: a null text encodes as an empty one (begin and end id only, decoded to the empty
string); a character without a piece becomes its bytes' pieces, or the unknown id in a model without
them; equal scores go to the leftmost pair, as in the library; every input row gives one output row,
repeated rows too; other columns of the input are not looked at.
"""

from __future__ import annotations

import codecs
import heapq
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .merges import PairTable
from .pieces import gather

SIGN = "▁"
#: The rank of a pair that is no piece.
_NONE = np.int64(1 << 40)
#: Words of more characters are encoded each time instead of being remembered.
LONGEST = 48
#: Words that one worker remembers; then it starts anew.
REMEMBERED = 200_000
#: Segments of more symbols are merged with a heap: rounds would cost the square of their length.
LONG_SEGMENT = 2_000


class PieceModel:
    """The tables of one model file, given as its bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        if lib.normalize(" a  Ａ ") != f"{SIGN * 2}a{SIGN * 2}Ａ{SIGN}":
            raise ValueError("only models with the identity normaliser and a leading piece sign are supported")
        pieces = [lib.id_to_piece(i) for i in range(len(lib))]
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        is_byte = [lib.is_byte(i) for i in range(len(lib))]
        special = [lib.is_control(i) or lib.is_unknown(i) for i in range(len(lib))]
        if any(lib.is_unused(i) for i in range(len(lib))):
            raise ValueError("models with unused pieces are not supported")
        ids = {p: i for i, p in enumerate(pieces) if not is_byte[i] and not special[i]}
        self.bytes = np.full(256, -1, np.int32)
        for i, p in enumerate(pieces):
            if is_byte[i]:
                self.bytes[int(p[1:-1], 16)] = i
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        longer = [p for p in ids if len(p) > 1]
        scores = np.array([lib.get_score(ids[p]) for p in longer], np.float32)
        order = np.unique(-scores, return_inverse=True)[1]         # equal scores are one rank
        pairs, merged, rank, beside = [], [], [], set()
        for p, r in zip(longer, order.tolist()):
            beside.update(zip(p, p[1:]))
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs.append((a, b))
                    merged.append(ids[p])
                    rank.append(r)
        if any(c not in ids for two in beside for c in two):
            raise ValueError("a piece holds a character that is no piece")
        self.pairs = PairTable(np.array(pairs, np.int64).reshape(-1, 2), np.array(merged, np.int32))
        self.rank, self.merged = np.array(rank, np.int64), np.array(merged, np.int32)
        neighbours = np.array([(ids[a], ids[b]) for a, b in beside], np.int64).reshape(-1, 2)
        self.neighbours = PairTable(neighbours, np.zeros(len(neighbours), np.int32))
        whole = any(b == SIGN != a or "\n" in (a, b) for a, b in beside)
        self.words = (lambda s: [s]) if whole else re.compile(f"{SIGN}*[^{SIGN}\n]+|{SIGN}+|\n+").findall
        raw = [b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i)
               else bytes([int(p[1:-1], 16)]) if is_byte[i] else p.replace(SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.raw_len = np.fromiter(map(len, raw), np.int64, len(raw))
        self.raw_start = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.control = np.array([lib.is_control(i) for i in range(len(lib))])
        self.spaced = np.array([p.startswith(SIGN) for p in pieces])

    # -- merging ---------------------------------------------------------------------------

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs of symbols; rank _NONE where they are no piece."""
        at = self.pairs.ranks(left, right)
        known = at < len(self.rank)
        at = np.where(known, at, 0)
        return np.where(known, self.rank[at], _NONE), self.merged[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each)."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        lens = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lens)
        sym = self.char[points]
        cut = word[1:] != word[:-1]
        cut |= (sym[1:] < 0) | (sym[:-1] < 0)
        cut[~cut] = self.neighbours.ranks(sym[:-1][~cut], sym[1:][~cut]) == _NONE
        segment = np.r_[0, np.cumsum(cut)]
        sym, at = self._merge(sym, segment)
        word, ids, n = word[at], sym, np.ones(len(sym), np.int64)
        bare = np.flatnonzero(sym < 0)
        if len(bare):
            spelled = [self._spell(int(c)) for c in points[at[bare]]]
            n[bare] = [len(x) for x in spelled]
            ids = np.repeat(sym, n)
            ids[ids < 0] = np.concatenate(spelled)
        return ids, np.bincount(word, weights=n, minlength=len(words)).astype(np.int64)

    def _spell(self, point: int) -> np.ndarray:
        ids = self.bytes[np.frombuffer(chr(point).encode(), np.uint8)]
        return np.array([self.unknown], np.int32) if (ids < 0).any() else ids

    def _merge(self, sym: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols that remain, place of the first character of each)."""
        at = np.arange(len(sym))
        size = np.bincount(segment)[segment]
        done = [(sym[size == 1], at[size == 1])]
        for s in np.unique(segment[size > LONG_SEGMENT]).tolist():
            a, b = np.searchsorted(segment, [s, s + 1])
            kept, places = self._heap(sym[a:b].tolist())
            done.append((np.array(kept, np.int32), a + np.array(places, np.int64)))
        go = (size > 1) & (size <= LONG_SEGMENT)
        sym, at, segment = sym[go], at[go], segment[go]
        rank, merged = np.full(len(sym), _NONE), np.zeros(len(sym), np.int32)
        self._look(sym, segment, rank, merged, np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            ended = best == _NONE
            if ended.any():
                done.append((sym[ended], at[ended]))
                go = ~ended
                sym, at, segment, rank, merged, best = (x[go] for x in (sym, at, segment, rank, merged, best))
                if not len(sym):
                    break
            take = self._round(sym, segment, rank, merged, best)
            sym[take] = merged[take]
            go = np.ones(len(sym), bool)
            go[take + 1] = False
            sym, at, segment, rank, merged = (x[go] for x in (sym, at, segment, rank, merged))
            take -= np.arange(len(take))
            self._look(sym, segment, rank, merged, np.unique(np.r_[take, take[take > 0] - 1]))
        sym, at = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at)
        return sym[order], at[order]

    def _look(self, sym, segment, rank, merged, at) -> None:
        """Look up the pairs that begin at ``at``."""
        rank[at] = _NONE
        at = at[at + 1 < len(sym)]
        at = at[segment[at] == segment[at + 1]]
        rank[at], merged[at] = self.find(sym[at], sym[at + 1])

    def _round(self, sym, segment, rank, merged, best) -> np.ndarray:
        """Where to merge now: of each segment's pairs of the best rank, from the left and without
        overlap, those before and up to the first merge that makes a pair of that rank or a better one,
        which the agenda would take next."""
        at = np.flatnonzero(rank == best)
        first = np.r_[True, at[1:] != at[:-1] + 1]
        offset = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        at = at[offset % 2 == 0]
        new, own, n = merged[at], segment[at], len(sym)
        left = np.where(at > 0, sym[at - 1], -1)
        beside = np.r_[False, (at[1:] == at[:-1] + 2)]
        left[beside] = new[np.flatnonzero(beside) - 1]
        has_left = (at > 0) & (segment[at - 1] == own)
        right_at = np.minimum(at + 2, n - 1)
        has_right = (at + 2 < n) & (segment[right_at] == own)
        stop = np.zeros(len(at), bool)
        stop[has_left] = self.find(left[has_left], new[has_left])[0] <= best[at[has_left]]
        stop[has_right] |= self.find(new[has_right], sym[right_at[has_right]])[0] <= best[at[has_right]]
        if not stop.any():
            return at
        before = np.cumsum(stop) - stop
        head = np.r_[True, own[1:] != own[:-1]]
        return at[before == before[np.flatnonzero(head)][np.cumsum(head) - 1]]

    def _heap(self, sym: list[int]) -> tuple[list[int], list[int]]:
        """One long segment, merged with an agenda of its pairs."""
        n = len(sym)
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, new = (x.tolist() for x in self.find(np.array(sym[:-1]), np.array(sym[1:])))
        agenda = [(r, i, 2, m) for i, (r, m) in enumerate(zip(ranks, new)) if r < _NONE]
        heapq.heapify(agenda)
        known: dict = {}

        def add(i: int, j: int) -> None:
            if i < 0 or j >= n:
                return
            two = (sym[i], sym[j])
            if two not in known:
                r, m = self.find(np.array(two[:1]), np.array(two[1:]))
                known[two] = (int(r[0]), int(m[0]))
            r, m = known[two]
            if r < _NONE:
                heapq.heappush(agenda, (r, i, size[i] + size[j], m))

        while agenda:
            _, i, span, m = heapq.heappop(agenda)
            j = after[i]
            if not size[i] or j >= n or size[i] + size[j] != span:
                continue                                   # one of the two was merged meanwhile
            sym[i], size[i], size[j], after[i] = m, span, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            add(before[i], i)
            add(i, after[i])
        places = [i for i in range(n) if size[i]]
        return [sym[i] for i in places], places

    # -- decoding --------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library gives it."""
        data = gather(self.raw, self.raw_start[ids], self.raw_len[ids]).tobytes()
        said = np.flatnonzero(~self.control[ids])
        if len(said) and self.spaced[ids[said[0]]]:
            data = data[1:]
        return data.decode("utf-8", _REPLACE)


_REPLACE = "lanescope-each-byte"


def _each_byte(error: UnicodeDecodeError):
    return "�" * (error.end - error.start), error.end


codecs.register_error(_REPLACE, _each_byte)


class PieceCoder:
    """Encodes many texts, remembering words."""

    def __init__(self, model: bytes, limit: int = REMEMBERED):
        self.model, self.limit = PieceModel(model), limit
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list) -> list[np.ndarray]:
        """The ids of each text between begin and end id."""
        if len(self.starts) > self.limit or len(self.ids) > 16 * self.limit:
            self._forget()
        slots, count, new, split = self.slots, len(self.starts), [], self.model.words
        runs = []
        for text in texts:
            run = []
            for w in split(SIGN + text.replace(" ", SIGN)) if text else ():
                slot = slots.get(w)
                if slot is None:
                    slot = count + len(new)
                    new.append(w)
                    if len(w) <= LONGEST:
                        slots[w] = slot
                run.append(slot)
            runs.append(run)
        ids, n = self.model.encode_words(new)
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(n) - n]
        self.lens, self.ids = np.r_[self.lens, n], np.r_[self.ids, ids]
        out = []
        for run in runs:
            run = np.array(run, np.int64)
            out.append(np.r_[np.int32(self.model.begin), gather(self.ids, self.starts[run], self.lens[run]), np.int32(self.model.end)])
        return out


_CODERS: dict = {}


def worker_coder(model: bytes) -> PieceCoder:
    """One coder per worker process and model, kept between its tasks."""
    key = hash(model)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = PieceCoder(model)
    return _CODERS[key]


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids): ids with begin and end id as binary, little-endian unsigned 32-bit. decoded: adds column
    ``decoded``, the ids decoded again in the same pass."""
    file = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        coder = worker_coder(file.value)
        for batch in slices(batches, 256):
            ids = coder.encode(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
            if decoded:
                columns.append(pa.array(map(coder.model.decode, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][:len(columns)])

    return docs.mapInArrow(run, f"id {kind}, ids binary" + ", decoded string" * decoded).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded); null ids decode as none."""
    file = encoded.sparkSession.sparkContext.broadcast(model)
    encoded = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        text_of = worker_coder(file.value).model.decode
        for batch in slices(batches, 256):
            texts = [text_of(np.frombuffer(raw or b"", "<u4").astype(np.int64)) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    return encoded.mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)
