"""Near-duplicate documents by improved consistent weighted sampling (ICWS).

A document is a weighted set: its distinct runs of five words, weighted by how often they occur
times the mean inverse document frequency of their words. ICWS draws samples of it such that two documents
agree in a sample with a probability equal to their weighted Jaccard similarity; bands of samples
give candidates, whose weighted Jaccard similarity is then computed in full. Linked documents
form groups by connected components.

Document frequencies of words are counted exactly over all documents; a shingle's inverse frequency is
the mean of its words', 1 + ln(N / n) / ln(``RAREST``), from 1 to 2, by one rule at every size of the
corpus. The random variates of a (shingle, sample) come from tables that a hash of both indexes.

Exact copies (equal text) are one candidate. ``ROWS`` samples a band and ``BANDS`` bands find a
pair of similarity 0.8 with probability 0.998, one of 0.9 all but surely; of such pairs fewer than one in
100,000 shares less than ``LEAST_SHARED`` samples and is passed over.

Defined results: null texts are linked with nothing, not even each other; texts without words only with
equal ones; a text of fewer than five words has one shingle, all its words; of a group the smallest doc_id is kept (a
null id only where the whole group has none; of repeated rows one); other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_side, stored
from .graph import shared_buckets
from .tiles import TILE, tile_links
from .words import WordHashes, find_words, mixed, shingles

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
#: A word found in fewer than one of so many documents weighs like one found in just that share.
RAREST = 1 << 14
#: Of the 48 samples a pair of similarity 0.8 shares 38 on average; fewer than so many are no candidate.
LEAST_SHARED = 25
_TABLE = 1 << 16
#: Shingles looked at in one step, whose numbers stay in the processor's cache.
_STEP = 768


class InverseFrequencies:
    """Inverse document frequencies of words by 64-bit hash, 1 + ln(N / n) / ln(RAREST), from 1 to 2."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray, docs: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.weights = (1 + np.log(max(docs, 1) / n[order]) / np.log(RAREST)).clip(1, 2).astype(np.float32)

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(words), 2, np.float32)
        distinct, back = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
        return np.where(self.hashes[at] == distinct, self.weights[at], np.float32(2))[back]


def inverse_frequencies(docs: DataFrame) -> InverseFrequencies:
    """Exact document frequencies over all of ``docs`` (text). Words rarer than one in ``RAREST``
    documents need no entry, so the table holds at most ``RAREST`` times a document's mean number of
    distinct words, at every size of the corpus."""

    def count(batches):
        import pyarrow as pa

        def out():
            keys = np.fromiter(found, np.uint64, len(found))
            return pa.RecordBatch.from_pydict({"word": keys.view(np.int64), "n": np.fromiter(found.values(), np.int64, len(found))})

        known, found = WordHashes(), {}
        for batch in slices(batches, 512):
            for text in batch.column(0).to_pylist():
                for h in known.of(list(set(find_words((text or "").lower())))).tolist():
                    found[h] = found.get(h, 0) + 1
            if len(found) > 1_000_000:
                yield out()
                found = {}
        yield out()

    n = docs.count()
    got = (docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
           .filter(F.col("n") * RAREST >= n).toArrow())
    return InverseFrequencies(got.column("word").to_numpy().view(np.uint64), got.column("n").to_numpy(), n)


def weighted_set(text: str | None, idf: InverseFrequencies, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes and their weights."""
    words = known.of(find_words((text or "").lower()))
    if not len(words):
        return words, np.zeros(0, np.float32)
    size = min(SHINGLE, len(words))
    own = idf.of(words)
    mean = sum(own[k:len(own) - size + 1 + k] for k in range(size)) / np.float32(size)
    keys, first, times = np.unique(shingles(words, SHINGLE), return_index=True, return_counts=True)
    return keys, (mean[first] * times).astype(np.float32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of the smaller over sum of the larger weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    either = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - both
    return both / either if either > 0 else 0.0


class Sampler:
    """ICWS samples of weighted sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        r = rng.gamma(2.0, 1.0, _TABLE).astype(np.float32)
        self.r, self.over_r = r, 1 / r
        self.log_c = np.log(rng.gamma(2.0, 1.0, _TABLE)).astype(np.float32) - r
        self.beta = rng.random(_TABLE, np.float32)
        self.seeds = rng.integers(1, 1 << 62, bands * rows, np.int64).astype(np.uint64)

    def samples(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit number a sample, the drawn shingle and its level."""
        k = len(self.seeds)
        best, drawn, levels = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64), np.zeros(k, np.float32)
        every = np.arange(k)
        for at in range(0, len(keys), _STEP):
            h, log_w = keys[at:at + _STEP], np.log(weights[at:at + _STEP])
            i = (((h[None, :] ^ self.seeds[:, None]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.intp)
            t = np.take(self.over_r, i)
            t *= log_w
            beta = np.take(self.beta, i)
            t += beta
            np.floor(t, out=t)
            np.subtract(t, beta, out=beta)
            beta *= np.take(self.r, i)
            value = np.take(self.log_c, i)
            value -= beta
            low = value.argmin(axis=1)
            v = value[every, low]
            better = v < best
            best[better], drawn[better], levels[better] = v[better], h[low[better]], t[every, low][better]
        return mixed(drawn ^ mixed(levels.astype(np.int64).astype(np.uint64)))

    def sketch(self, keys: np.ndarray, weights: np.ndarray) -> bytes:
        """Band keys, 16 bits of each sample, and the total weight."""
        drawn = self.samples(keys, weights)
        s = drawn.reshape(self.bands, self.rows)
        out = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            out = mixed(out ^ s[:, k])
        return out.tobytes() + (drawn >> np.uint64(48)).astype(np.uint16).tobytes() + np.float32(weights.sum(dtype=np.float64)).tobytes()


#: Bytes of a sketch.
WIDTH = BANDS * 8 + BANDS * ROWS * 2 + 4


def may_be_similar(threshold: float):
    """Pairs of one bucket whose total weights and samples allow the threshold; a pair that shares
    several buckets only in the first of them."""

    def select(bucket: int, sketches: np.ndarray) -> np.ndarray:
        bands = np.ascontiguousarray(sketches[:, :BANDS * 8]).view(np.int64)
        samples = np.ascontiguousarray(sketches[:, BANDS * 8:-4]).view(np.uint16)
        total = np.ascontiguousarray(sketches[:, -4:]).view(np.float32)[:, 0].astype(np.float64)
        out = np.empty((len(bands), len(bands)), bool)
        for k in range(len(bands)):
            same = bands == bands[k]
            out[k] = bands[k][same.argmax(axis=1)] == bucket
            out[k] &= (samples == samples[k]).sum(axis=1) >= LEAST_SHARED
            out[k] &= np.minimum(total, total[k]) >= (threshold - 1e-4) * np.maximum(total, total[k])
        return out

    return select


def compared(threshold: float):
    """Weighted Jaccard similarity of one set with many others of a tile at once."""

    def prepare(raw: list[bytes]):
        sets = [(np.frombuffer(x, np.uint64, len(x) // 12), np.frombuffer(x, np.float32, len(x) // 12, len(x) // 12 * 8)) for x in raw]

        def similar(k: int, others: np.ndarray) -> np.ndarray:
            if len(others) < 4:
                return np.array([similarity(sets[k], sets[o]) >= threshold for o in others], bool)
            keys, weights = sets[k]
            out = np.zeros(len(others), bool)
            for at in range(0, len(others), 64):
                some = [sets[o] for o in others[at:at + 64]]
                lens = np.array([len(x[0]) for x in some])
                theirs, heavy = np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some]).astype(np.float64)
                place = np.minimum(np.searchsorted(keys, theirs), len(keys) - 1)
                least = np.where(keys[place] == theirs, np.minimum(weights[place], heavy), 0.0)
                first = np.cumsum(lens) - lens
                both = np.add.reduceat(least, first)
                either = weights.sum(dtype=np.float64) + np.add.reduceat(heavy, first) - both
                out[at:at + 64] = both >= threshold * either
            return out

        return similar

    return prepare


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, text_md5 (binary), class_id, kept."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                        F.unhex(F.md5(F.col(f"`{text_col}`"))).alias("key"))
    kind = dict(texts.dtypes)["id"]
    table = spark.sparkContext.broadcast(inverse_frequencies(texts))

    def sign(batches):
        import pyarrow as pa

        known, sampler = WordHashes(), Sampler()
        for batch in slices(batches, 512):
            sketches = []
            for text in batch.column(2).to_pylist():
                keys, weights = weighted_set(text, table.value, known)
                sketches.append(sampler.sketch(keys, weights) if len(keys) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sketches, pa.binary())], ["id", "key", "sketch"])

    signed = stored(texts.select("id", "key", "text").mapInArrow(sign, f"id {kind}, key binary, sketch binary")
                    .withColumn("row", F.monotonically_increasing_id()), "icws-signatures")
    # exact copies stand together: their smallest id, and one signature
    first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row")).alias("first")
    copies = stored(signed.filter("key is not null").groupBy("key").agg(first, F.min("sketch").alias("sketch"))
                    .withColumn("node", F.monotonically_increasing_id()), "icws-texts")

    def bands(batches):
        import pyarrow as pa

        for batch in slices(batches, 4096):
            raw = batch.column(1).to_pylist()
            found = np.frombuffer(b"".join(x[:BANDS * 8] for x in raw), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(0).take(pa.array(np.repeat(np.arange(len(raw)), BANDS)))], ["bucket", "id"])

    buckets = shared_buckets(copies.filter("sketch is not null").select("node", "sketch").mapInArrow(bands, "bucket long, id long"))
    sketches = copies.select(F.col("node").alias("own"), "sketch")
    buckets = stored(buckets.join(sketches, F.col("id") == F.col("own")).select("bucket", "id", "sketch"), "icws-buckets")

    def weigh(batches):
        import pyarrow as pa

        known = WordHashes()
        for batch in slices(batches, 512):
            sets = [weighted_set(t, table.value, known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k.tobytes() + w.tobytes() for k, w in sets], pa.binary())], ["id", "data"])

    def sets(ids: DataFrame) -> DataFrame:
        wanted = stored(copies.join(ids, F.col("node") == F.col("id")).select("node", F.col("key").alias("wanted"), F.col("first.id").alias("first_id")), "icws-wanted")
        return stored(texts.join(small_side(wanted), (F.col("key") == F.col("wanted")) & F.col("id").eqNullSafe(F.col("first_id")))
                      .select("node", "text").mapInArrow(weigh, "id long, data binary").dropDuplicates(["id"]), "icws-sets")

    comp = stored(tile_links(buckets, WIDTH, may_be_similar(threshold), sets, compared(threshold), TILE).withColumnRenamed("node", "linked"), "icws-components")
    member = copies.join(comp, F.col("node") == F.col("linked"), "left").select(
        "key", "first", F.coalesce("component", "node").alias("class"))
    classes = member.groupBy("class").agg(F.min("first").alias("best"))
    member = stored(member.join(classes, "class").select(F.col("key").alias("member"), "best"), "icws-classes")
    rows = signed.join(small_side(member), F.col("key") == F.col("member"), "left")
    alone = F.col("best").isNull()
    return rows.select(F.col("id").alias(id_col), F.col("key").alias("text_md5"),
                       F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("class_id"),
                       (alone | (F.col("row") == F.col("best.row"))).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are not kept."""
    marked = groups(docs, id_col, text_col)
    kept = stored(marked.groupBy(F.col(id_col).alias("kept_id"), F.col("text_md5").alias("kept_md5"))
                  .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("kept").cast("int")).alias("stay"))
                  .filter("stay > 0").select("kept_id", "kept_md5", (F.col("rows") > F.col("stay")).alias("repeated")),
                  "icws-kept")
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    joined = docs.alias("d").join(
        small_side(kept).alias("k"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("k.kept_id"))
        & F.unhex(F.md5(F.col(f"d.`{text_col}`"))).eqNullSafe(F.col("k.kept_md5")))
    once = joined.filter("not k.repeated").select(*columns)
    again = joined.filter("k.repeated").dropDuplicates([id_col, "kept_md5"]).select(*columns)
    return once.union(again)
