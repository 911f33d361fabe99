"""Cross-entropy difference between a target and a background language model.

Both models are word bigram models with the same vocabulary, order and smoothing; the target's is
counted over the documents for which ``is_target`` holds, the background's over all. Words and pairs
of words are counted exactly, by 64-bit hashes, over all documents, into tables that grow with them.
p(w) = (c(w) + 1/2) / (N + V / 2), V: the number of distinct words and one for all unseen ones; p(w | v) = (c(v, w) + m p(w)) /
(c(v) + m), c(v): how often a word follows v. Before a document's first word stands a marker that occurs once in each document with a
word. So the probabilities after each context sum to 1. A document's score is the mean over its tokens of the target loss less
the background loss, in nats: the lower, the nearer to the target.

A loss is log(c(v) + m) - log(c(v, w) + m p(w)). The texts are read twice: first for the counts of all words and of the pairs of two
of ``HOT`` frequent words, then for all other pairs, which are shuffled once and counted and scored where they meet. The counts of the
``KNOWN`` most frequent words are at hand there, and their pairs meet by pair; a pair with any other word w meets by w, whose
occurrences then all lie together, and so do, in rows of their own, the contexts of any other word v. Nothing else is cut off: which
words are hot or known decides only where a term is summed.

Defined results: a text that is null or has no word has no tokens, its losses and score are null; without
target documents the target model is uniform; every input row gets a row, repeated rows too; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, slices, small_side, stored
from .tiles import whole_runs
from .words import WordHashes, find_words, mixed

SMOOTHING = 4.0
#: So many of the most frequent words have their pairs counted in an array; the result is the same.
HOT = 512
#: The hot words are looked for in about so many rows.
HOT_ROWS = 4_096
#: So many of the most frequent words have their counts broadcast; the others' occurrences are few enough to meet in one task.
KNOWN = 65_536
#: Where the words are too many for a broadcast, a frequent word's pairs go to so many tasks.
SALTS = 16


def _words(text: str | None, known: WordHashes) -> np.ndarray:
    return known.of(find_words((text or "").lower()))


def _summed(rows: np.ndarray, target: np.ndarray):
    """Distinct rows of (k, n) numbers, how often they occur in the target and in all."""
    kinds = np.ascontiguousarray(rows.T).view([("", rows.dtype)] * len(rows)).reshape(-1) if len(rows) > 1 else rows[0]
    order = np.lexsort(rows[::-1])
    kinds, target = kinds[order], target[order]
    first = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]) if len(kinds) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(kinds)])
    inside = np.add.reduceat(target.astype(np.int64), first) if len(first) else first
    return rows[:, order[first]], inside, times


#: The marker's key among the words.
MARKER = 0


def _split(batch_words: list[np.ndarray], hot: np.ndarray):
    """Of all words of some documents: document, word before (0 before the first), word, and the
    cell of the pair among the hot words (-1: not both are hot). hot: ascending, the marker first."""
    n = np.array([len(g) for g in batch_words], np.int64)
    words = np.concatenate(batch_words)
    before = np.r_[np.zeros(1, np.uint64), words[:-1]][:len(words)]
    before[(np.cumsum(n) - n)[n > 0]] = 0
    at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
    at[hot[at] != words] = -1
    at_before = np.r_[np.full(1, -1), at[:-1]][:len(words)]
    at_before[(np.cumsum(n) - n)[n > 0]] = 0
    return np.repeat(np.arange(len(n)), n), before, words, np.where((at >= 0) & (at_before >= 0), at_before * len(hot) + at, -1)


def hot_words(docs: DataFrame) -> np.ndarray:
    """The marker and the ``HOT`` most frequent words of about ``HOT_ROWS`` rows, ascending. Which words these are
    decides where a pair is summed, not what comes out. docs: (text, ...)."""
    rows = docs.count()
    some = docs.select("text") if rows <= HOT_ROWS else docs.select("text").sample(HOT_ROWS / rows, seed=1)

    def run(batches):
        import pyarrow as pa

        known = WordHashes()
        for batch in slices(batches, 512):
            words, times = np.unique(np.concatenate([_words(t, known) for t in batch.column(0).to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": words.view(np.int64), "n": times})

    counted = some.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    hot = np.array([r.word for r in counted.orderBy(F.desc("n"), "word").limit(HOT).collect()], np.int64).view(np.uint64)
    return np.unique(np.r_[np.uint64(MARKER), hot])


def counts(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(v, word, t, b, ct, cb). v null: a word or the marker, its occurrences in the target and in all documents, and those
    that a word follows. Else a pair of two hot words and its occurrences. docs: (text, target)."""

    def run(batches):
        import pyarrow as pa

        known, cells = WordHashes(), np.zeros((2, len(hot) ** 2), np.int64)
        for batch in slices(batches, 512):
            got = [_words(t, known) for t in batch.column(0).to_pylist()]
            inside = np.array(batch.column(1).to_pylist(), bool)
            doc, _, words, cell = _split(got, hot)
            target, both = inside[doc], cell >= 0
            cells[0] += np.bincount(cell[both & target], minlength=len(hot) ** 2)
            cells[1] += np.bincount(cell[both], minlength=len(hot) ** 2)
            rows, t, b = _summed(words[None, :], target)
            some = np.array([len(g) > 0 for g in got], bool)
            ends, et, eb = _summed(np.array([g[-1] for g in got if len(g)], np.uint64)[None, :], inside[some])
            nothing = np.zeros(len(et) + 1, np.int64)
            word = np.r_[rows[0].view(np.int64), ends[0].view(np.int64), MARKER]
            yield pa.RecordBatch.from_pydict({
                "v": pa.nulls(len(word), pa.int64()), "word": word, "t": np.r_[t, nothing], "b": np.r_[b, nothing],
                "ct": np.r_[t, -et, (inside & some).sum()], "cb": np.r_[b, -eb, some.sum()]})
        seen = np.flatnonzero(cells[1])
        nothing = np.zeros(len(seen), np.int64)
        signed = hot.view(np.int64)
        yield pa.RecordBatch.from_pydict({"v": signed[seen // len(hot)], "word": signed[seen % len(hot)], "t": cells[0, seen],
                                          "b": cells[1, seen], "ct": nothing, "cb": nothing})

    found = docs.mapInArrow(run, "v long, word long, t long, b long, ct long, cb long")
    return found.groupBy("v", "word").agg(*[F.sum(c).alias(c) for c in ("t", "b", "ct", "cb")])


def _with_words(pairs: DataFrame, words: DataFrame, n_words: int, side: str, limit: int) -> DataFrame:
    """``pairs`` with the counts of their word ``side`` (v: as a context), 0 where it has none."""
    counts = ("t", "b") if side == "w" else ("ct", "cb")
    words = words.select(F.col("word").alias(f"{side}_word"), *[F.col(c).alias(f"{side}_{c[-1]}") for c in counts])
    on = F.col(side) == F.col(f"{side}_word")
    if n_words <= limit:
        pairs = pairs.join(F.broadcast(words), on, "left")
    else:
        words = words.withColumn("word_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("v", "w"), F.lit(SALTS)).cast("int"))
        pairs = pairs.join(words.hint("merge"), on & (F.col("salt") == F.col("word_salt")), "left").drop("salt", "word_salt")
    return pairs.drop(f"{side}_word").fillna(0, [f"{side}_t", f"{side}_b"])


def totals(words: DataFrame) -> dict:
    """n: distinct words; t, b: occurrences in the target and in all documents."""
    total = words.agg(F.count_if(F.col("word") != MARKER).alias("n"), F.sum("t").alias("t"), F.sum("b").alias("b")).first()
    return {c: total[c] or 0 for c in "ntb"}


def _mass(total: dict, x: str) -> float:
    return total[x] + (total["n"] + 1) / 2


def pair_losses(pairs: DataFrame, words: DataFrame, limit: int = BROADCAST_ROWS, total: dict | None = None) -> DataFrame:
    """(v, w, lt, lb): losses of w after v by the target's and the background's model. words: stored, all or, with the
    ``total`` of all, those of the pairs."""
    n_words = words.count() if total else None
    total = total or totals(words)
    for side in ("w", "v"):
        pairs = _with_words(pairs, words, total["n"] if n_words is None else n_words, side, limit)

    def loss(x: str) -> Column:
        p = (F.col(f"w_{x}") + 0.5) / F.lit(_mass(total, x))
        return -F.log((F.col(x) + F.lit(SMOOTHING) * p) / (F.col(f"v_{x}") + F.lit(SMOOTHING)))

    return pairs.select("v", "w", loss("t").alias("lt"), loss("b").alias("lb"))


#: Kinds of rows that are shuffled by ``key``, below twice as large and with 1 added for a document of the target: a pair of known words
#: (key: their places), a pair with a known w only (key: the pair, other: the place of w), a pair with another w (key: w, other: v),
#: a context v that is not known (key: v), and what is known of a document (key: the document, other: sums as bits of a double, or
#: the number of tokens).
BOTH, PAIR, RARE, CONTEXT, OWN_T, OWN_B, TOKENS = range(7)
#: Bits of a known word's place.
PLACE = 17


def _table(rows: DataFrame, word: str) -> tuple[np.ndarray, dict]:
    """The words of some rows, ascending, and their counts in that order."""
    got = rows.toArrow()
    words, first = np.unique(got.column(word).to_numpy().view(np.uint64), return_index=True)
    return words, {c: got.column(c).to_numpy()[first] for c in ("t", "b", "ct", "cb")}


def _events(docs: DataFrame, shared) -> DataFrame:
    """(key, other, doc, kind) of all documents, see ``PAIR``. docs: (doc, target, text)."""

    def run(batches):
        import pyarrow as pa

        seen, (known, hot_at, contexts, _, table) = WordHashes(), shared.value
        side = int(len(table[0]) ** 0.5)
        out = lambda key, other, doc, kind: pa.RecordBatch.from_pydict({
            "key": key.view(np.int64), "other": other.view(np.int64), "doc": doc, "kind": kind.astype(np.int32)})
        for batch in slices(batches, 512):
            got = [_words(t, seen) for t in batch.column(2).to_pylist()]
            key, inside = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), np.int64)
            n = np.array([len(g) for g in got], np.int64)
            words = np.concatenate(got)
            firsts = (np.cumsum(n) - n)[n > 0]
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            at[known[at] != words] = -1
            before, at_before = (np.r_[x[:1], x[:-1]] for x in (words, at))
            before[firsts], at_before[firsts] = MARKER, 0
            doc = np.repeat(np.arange(len(n)), n)
            spot, spot_before = (np.where(x >= 0, hot_at[x], -1) for x in (at, at_before))
            hits = (spot >= 0) & (spot_before >= 0)
            cell, plain = spot_before * side + spot, ~hits & (at_before >= 0)
            for kind, losses, context in zip((OWN_T, OWN_B), table, contexts):
                sums = np.bincount(doc[hits], losses[cell[hits]], len(n)) + np.bincount(doc[plain], context[at_before[plain]], len(n))
                yield out(key, sums, key, np.full(len(n), 2 * kind))
            yield out(key, n, key, np.full(len(n), 2 * TOKENS))
            nothing = np.zeros(len(words), np.int64)
            for kind, some, k, other in (
                    (BOTH, plain & (at >= 0), at_before << PLACE | at, nothing),
                    (PAIR, (at >= 0) & (at_before < 0), mixed(mixed(before) ^ words), at),
                    (RARE, at < 0, words, before), (CONTEXT, at_before < 0, before, nothing)):
                d = doc[some]
                yield out(k[some], other[some], key[d], 2 * kind + inside[d])

    return docs.mapInArrow(run, "key long, other long, doc long, kind int")


def _run_sums(starts: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """For each row, how many rows of the target and how many in all its run has."""
    lens = np.diff(np.r_[starts, len(target)])
    return [np.repeat(x, lens) for x in (np.add.reduceat(target, starts) if len(starts) else starts, lens)]


def _terms(events: DataFrame, shared, mass: tuple[float, float]) -> DataFrame:
    """(doc, lt, lb, tokens): each row's terms, tokens in one row a document, else null. events: dealt and sorted by key."""

    def terms(key, other, kind):
        """The terms of each row in the target's and the background's loss."""
        _, _, _, p_known, _ = shared.value
        out, target, kind = np.zeros((2, len(key))), kind & 1, kind >> 1
        for own, row in ((OWN_T, 0), (OWN_B, 1)):
            out[row, kind == own] = other[kind == own].view(np.float64)
        for k in (BOTH, PAIR, RARE, CONTEXT):
            at = np.flatnonzero(kind == k)
            keys = key[at]
            c = _run_sums(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(at) else at, target[at])
            if k == CONTEXT:
                out[:, at] = [np.log(x + SMOOTHING) for x in c]
            elif k != RARE:
                place = other[at] if k == PAIR else keys & (1 << PLACE) - 1
                out[:, at] = [-np.log(x + SMOOTHING * p[place]) for x, p in zip(c, p_known)]
            else:
                order = np.lexsort((other[at], keys))
                at, keys, c, v = at[order], keys[order], [x[order] for x in c], other[at[order]]
                pair = _run_sums(np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (v[1:] != v[:-1])]) if len(at) else at, target[at])
                out[:, at] = [-np.log(x + SMOOTHING * ((n + 0.5) / m)) for x, n, m in zip(pair, c, mass)]
        return out

    def run(batches):
        import pyarrow as pa

        for part in whole_runs(batches, 1):
            key, other, doc, kind = (part.column(k).to_numpy() for k in range(4))
            lt, lb = terms(key, other, kind)
            yield pa.RecordBatch.from_pydict({"doc": doc, "lt": lt, "lb": lb, "tokens": pa.array(other, mask=kind >> 1 != TOKENS)})

    return events.mapInArrow(run, "doc long, lt double, lb double, tokens long")


def score(docs: DataFrame, is_target: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                       F.coalesce(is_target, F.lit(False)).alias("target"))
    hot = hot_words(docs)
    counted = stored(counts(docs.select("text", "target"), hot), "lm-counts")
    words = counted.filter("v is null").drop("v")
    total = totals(words)
    mass = _mass(total, "t"), _mass(total, "b")
    is_hot = F.col("word").isin(hot.view(np.int64).tolist())
    frequent = words.filter(F.col("word") != MARKER).orderBy(F.desc("b"), "word").limit(KNOWN)
    known, n = _table(frequent.union(words.filter(is_hot)), "word")
    hot_at = np.full(len(known), -1)
    if len(known):                                        # else there are no rows; the marker is the first
        hot_at[np.searchsorted(known, hot)] = np.arange(len(hot))
    contexts = [np.log(n[c] + SMOOTHING) for c in ("ct", "cb")]
    p_known = [(n[x] + 0.5) / m for x, m in zip("tb", mass)]
    cells = pair_losses(counted.filter("v is not null").select("v", F.col("word").alias("w"), "t", "b"), words.filter(is_hot), total=total).toArrow()
    table = np.zeros((2, len(hot) ** 2))
    at = [np.searchsorted(hot, cells.column(c).to_numpy().view(np.uint64)) for c in ("v", "w")]
    table[:, at[0] * len(hot) + at[1]] = cells.column("lt").to_numpy(), cells.column("lb").to_numpy()
    shared = spark.sparkContext.broadcast((known, hot_at, contexts, p_known, table))
    # equal texts share a key, told apart by 64 bits like the words
    doc = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    events = _events(docs.filter("text is not null").select(doc.alias("doc"), F.col("target").cast("int").alias("target"), "text"), shared)
    found = _terms(events.repartition("key").sortWithinPartitions("key"), shared, mass)
    # rows of equal text are summed together; the mean over their tokens is that of each
    texts = stored(found.groupBy("doc").agg((F.sum("tokens") / F.count("tokens")).cast("long").alias("n_tokens"),
                                            F.try_divide(F.sum("lt"), F.sum("tokens")).alias("target_loss"),
                                            F.try_divide(F.sum("lb"), F.sum("tokens")).alias("background_loss")), "lm-texts")
    return (docs.select("id", doc.alias("own_doc")).join(small_side(texts), F.col("own_doc") == F.col("doc"), "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "target_loss", "background_loss",
                    (F.col("target_loss") - F.col("background_loss")).alias("score")))
