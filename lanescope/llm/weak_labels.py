"""Quality classifier from weak labels.

Overlapping heuristics ("labellers") look at signals of each whole text and vote bad, good or not at
all. Spark counts the vote patterns over all documents; expectation-maximisation over these counts
(at most 3 to the number of labellers, so the driver sees a bounded table) estimates how each
labeller votes on good and bad documents, which gives every pattern a posterior. Those soft labels
train a linear scorer on hashed word shapes beside the signals; the scorer decides.

Signals, votes and hashed shapes are computed once a document and stored in the shared folder (without the text, if the
caller does not ask for it); counting, fitting and scoring read that table. The scorer is fitted on a sample of about
``TRAIN_ROWS`` documents, drawn row by row, so that a text with many copies takes its share and no more; signals, pattern
counts, posteriors and scores cover all documents and whole texts.

Defined results: a null or blank text scores 0 and is rejected; repeated rows each get the same
score; an empty table gives no rows; columns of the input are kept whatever their names, the
operator's own columns come in one struct column.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Documents of which the scorer is fitted (a bounded sample of the rows).
TRAIN_ROWS = 20_000
#: Buckets of the hashed word shapes.
BUCKETS = 1 << 12

#: labeller: (signal, bad from, good up to); no vote between. None: never votes good.
LABELLERS = {
    "symbols": ("symbols", 0.04, 0.01),
    "shouting": ("capitals", 0.5, 0.15),
    "exclamations": ("exclamations", 0.25, None),
    "cells": ("cells", 0.2, None),
    "repeated_phrases": ("repeated_phrases", 0.45, 0.15),
    "repeated_words": ("repeated_words", 0.2, 0.05),
    "long_words": ("word_length", 14.0, 8.0),
}
#: A word length between the thresholds of ``long_words``: no vote.
NO_LENGTH = 11.0


#: Characters that are no symbols: letters, marks, digits, white space, the plain punctuation of ASCII, and the quotes, dashes,
#: ellipsis and full stops of other scripts.
_PLAIN = (r"\p{L}\p{M}\p{N}\s.,;:!?'\"()|\-\u00a1\u00ab\u00b7\u00bb\u00bf\u0589\u060c\u061b\u061f\u06d4\u0964\u0965\u2010-\u2015\u2018-\u201f"
          r"\u2026\u2039\u203a\u3001-\u3003\u3008-\u3011\u3014-\u301f\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff3d\uff5b-\uff65")
#: Scripts written without spaces between words, where the length of a blank-separated word says nothing.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]+"
#: From this share of such characters on, ``long_words`` does not vote.
_UNSPACED_SHARE = 0.3


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def with_signals(docs: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds struct ``name``: words (count), shapes (array) and the signals of the labellers."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    # characters in runs of a class: what is gone when the runs are (one match a run, not one a character)
    runs = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    docs = docs.withColumn(name, F.struct(
        words.alias("w"), F.transform(words, lambda w: F.xxhash64(w)).alias("h"),
        runs(f"[^{_PLAIN}]+").alias("symbols"), runs(r"\p{Lu}+").alias("upper"), runs(r"\p{L}+").alias("letters"),
        ((F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("")))) / 2).alias("exclamations"),
        count(r"(?:^|\s)\|(?:\s|$)").alias("cells"), runs(_UNSPACED).alias("unspaced"), F.length(text).cast("double").alias("chars")))
    s, n = F.col(name), F.size(F.col(f"{name}.w")).cast("double")
    hashes = F.col(f"{name}.h")
    rest = F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0)))
    pairs = F.zip_with(hashes, rest, lambda a, b: a == b)
    triples = F.zip_with(F.zip_with(hashes, rest, lambda a, b: F.xxhash64(a, b)),
                         F.slice(hashes, 3, F.greatest(F.size(hashes) - 2, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    triples = F.filter(triples, lambda x: x.isNotNull())
    shape = lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(
        w, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), r"\p{N}+", "0")
    return docs.withColumn(name, F.struct(
        n.alias("words"), F.split(shape(F.array_join(s["w"], " ")), " ").alias("shapes"),
        _ratio(s["symbols"], s["chars"]).alias("symbols"), _ratio(s["upper"], s["letters"]).alias("capitals"),
        _ratio(s["exclamations"], n).alias("exclamations"), _ratio(s["cells"], n).alias("cells"),
        _ratio(n - 2 - F.size(F.array_distinct(triples)), n - 2).alias("repeated_phrases"),
        _ratio(F.size(F.filter(pairs, lambda x: x)).cast("double"), n - 1).alias("repeated_words"),
        F.when(s["unspaced"] < _UNSPACED_SHARE * s["chars"], _ratio(s["chars"], n)).otherwise(F.lit(NO_LENGTH)).alias("word_length")))


def votes(name: str) -> Column:
    """Array of -1 (bad), 0 (no vote) or 1 (good), one a labeller."""
    out = []
    for signal, bad, good in LABELLERS.values():
        x = F.col(f"{name}.{signal}")
        vote = F.when(x >= bad, F.lit(-1))
        out.append((vote if good is None else vote.when(x <= good, F.lit(1))).otherwise(F.lit(0)))
    return F.array(*out)


def label_model(patterns: list[tuple[int, ...]], counts: list[float], steps: int = 200) -> tuple[np.ndarray, dict]:
    """Posterior of "good" for each vote pattern, and the estimated model.

    Two classes, votes independent within a class; the start calls a pattern bad if any labeller
    does. Half a vote of each kind smooths the estimates."""
    v = np.array(patterns, np.int64).reshape(len(patterns), -1) + 1
    n = np.asarray(counts, np.float64)
    good = np.where((v == 0).any(axis=1), 0.05, 0.95)
    tables = prior = None
    for _ in range(steps):
        weight = np.stack([n * (1 - good), n * good])
        prior = (weight.sum(axis=1) + 1) / (n.sum() + 2)
        tables = np.stack([[np.bincount(v[:, j], weights=w, minlength=3) + 0.5 for j in range(v.shape[1])] for w in weight])
        tables /= tables.sum(axis=2, keepdims=True)
        logs = np.log(prior)[:, None] + np.log(tables)[:, np.arange(v.shape[1]), v].sum(axis=2)
        now = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        done = np.abs(now - good).max(initial=0) < 1e-9
        good = now
        if done:
            break
    return good, {"prior": prior, "tables": tables}


def score(docs: DataFrame, text_col: str = "text", name: str = "quality", train_rows: int = TRAIN_ROWS,
          columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or only its ``columns``) with a struct column ``name``: posterior (weak label, 1: good), score, keep."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = docs.columns if columns is None else columns
    base = with_signals(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), text.alias("text")), F.col("text"), "s")
    names = sorted({signal for signal, _, _ in LABELLERS.values()})
    base = base.select("doc", F.col("s.words").alias("words"), votes("s").alias("votes"), F.col("s.shapes").alias("shapes"),
                       *[F.col(f"s.{c}").alias(c) for c in names],
                       F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 20)).alias("pick"))
    hashed = HashingTF(numFeatures=BUCKETS, inputCol="shapes", outputCol="counts").transform(base)
    # the vote pattern as a number in base 3
    code = reduce(lambda a, j: a * 3 + F.col("votes")[j] + 1, range(len(LABELLERS)), F.lit(0))
    base = stored(hashed.withColumn("code", code).drop("shapes", "votes"), "weak-signals")

    seen = base.filter(F.col("words") > 0).groupBy("code").count().toArrow().to_pydict()
    total = sum(seen["count"])
    if not total:
        nothing = F.struct(F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("keep"))
        return docs.select(*[F.col(f"`{c}`") for c in kept], nothing.alias(name))
    patterns = [tuple(c // 3 ** k % 3 - 1 for k in reversed(range(len(LABELLERS)))) for c in seen["code"]]
    posterior, _ = label_model(patterns, seen["count"])
    table = [0.0] * 3 ** len(LABELLERS)              # finds a pattern's posterior, in a literal of bounded size
    for c, x in zip(seen["code"], posterior.tolist()):
        table[c] = x
    base = base.withColumn("posterior", F.element_at(F.lit(table), F.col("code") + 1))
    shaped = lambda df: VectorAssembler(inputCols=[*names, "shares"], outputCol="features").transform(
        Normalizer(p=1.0, inputCol="counts", outputCol="shares").transform(df))
    part = min(1.0, train_rows / total)
    sample = base.filter(F.col("words") > 0).filter(F.col("pick") < F.lit(int(part * (1 << 20)) + 1))
    train = (shaped(sample).select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight")))).alias("y"))
        .select("features", "y.label", "y.weight").filter(F.col("weight") > 1e-6))
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(train)
    scored = model.transform(shaped(base))
    value = F.when(F.col("words") > 0, vector_to_array("probability")[1]).otherwise(F.lit(0.0))
    return scored.select("doc.*", F.struct(
        F.when(F.col("words") > 0, F.col("posterior")).otherwise(F.lit(0.0)).alias("posterior"),
        value.alias("score"), (value >= 0.5).alias("keep")).alias(name))
