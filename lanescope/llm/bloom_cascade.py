"""URL rules by Bloom filter cascades.

A rule is a host and a path beginning; it fits its host and all subdomains. Every url has few keys
that could be rules: for each (number of host labels, path length) that occurs among the rules, the
end of its host and the beginning of its path. All distinct keys of all urls are the universe. A
cascade answers exactly, for any key of that universe, whether it is listed: level 0 holds the
listed keys, level 1 the unlisted keys of the universe that pass level 0, level 2 the listed keys
that pass level 1, and so on until nothing passes wrongly. A key is listed if the first level that
it fails has an odd number, or if it passes all levels and their number is odd. Urls then need no
join with the rules: the test runs where the url is.

Rules are taken in turns of at most ``TURN_KEYS``, which bounds the broadcast filters (a level has
at most about that many bits times ``BITS``); longer lists only make more turns.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is
allowed; ties of length go to the rule that sorts first; repeated rows and urls are judged each;
an empty table gives no rows; of the input only the id and the url are looked at.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BITS = 8                     # bits a key of a level
PROBES = 3
TURN_KEYS = 4_000_000        # listed keys of one cascade


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) between the first ``://`` and the next ``/``, ``?``, ``#``; path from there
    to ``?`` or ``#``; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def _positions(keys_a: np.ndarray, keys_b: np.ndarray, bits: int) -> np.ndarray:
    a, b = keys_a.astype(np.uint64), keys_b.astype(np.uint64) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(PROBES)])


class Cascade:
    """The levels' bit arrays; ``test`` takes, for each level, the two hashes of the keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels

    def test(self, hashes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        n = len(hashes[0][0]) if hashes else 0
        listed, open_ = np.zeros(n, bool), np.ones(n, bool)
        for k, bits in enumerate(self.levels):
            passed = passes(bits, *hashes[k])
            listed |= open_ & ~passed & (k % 2 == 1)
            open_ &= passed
        return listed | (open_ & (len(self.levels) % 2 == 1))


def passes(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = _positions(a, b, len(bits) * 8)
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _hashes(key: Column, level: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(2 * level)), F.xxhash64(F.lit(2 * level + 1), key)]


def _filter_of(keys: DataFrame, level: int, n: int) -> np.ndarray:
    """The bits that the keys set, gathered as distinct set bytes (at most ``BITS`` n / 8 of them)."""
    size = max(64, -(-n * BITS // 8))
    a, b = _hashes(F.col("key"), level)

    def at(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (batch.column(i).to_numpy() for i in range(2))
            flat = _positions(x, y, size * 8).reshape(-1)
            yield pa.RecordBatch.from_pydict({"byte": (flat >> np.uint64(3)).astype(np.int64),
                                              "bit": (1 << (flat & np.uint64(7)).astype(np.int32)).astype(np.int32)})

    got = keys.select(a, b).mapInArrow(at, "byte long, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size, np.uint8)
    out[got.column("byte").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
    return out


def _passing(keys: DataFrame, bits: np.ndarray, level: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(bits)
    a, b = _hashes(F.col("key"), level)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (batch.column(i).to_numpy() for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["key"]).filter(pa.array(passes(shared.value, x, y)))

    return keys.select("key", a.alias("a"), b.alias("b")).mapInArrow(keep, "key string")


def build(universe: DataFrame, listed: DataFrame, most_levels: int = 200) -> Cascade:
    """universe, listed: distinct keys in column ``key``."""
    # a listed key that no url has needs no exact answer, but does no harm either
    levels, inside = [], stored(listed.select("key").distinct(), "cascade-listed")
    outside, n = universe.select("key"), inside.count()
    listed_keys, n_next = inside, None
    while n and len(levels) < most_levels:
        bits = _filter_of(inside, len(levels), n)
        wrong = _passing(outside, bits, len(levels))
        if not levels:                       # the only look at the whole universe
            wrong = wrong.join(listed_keys, "key", "left_anti")
        wrong = stored(wrong, "cascade-level")
        levels.append(bits)
        n_next = wrong.count()
        inside, outside, n = wrong, inside, n_next
    if n:
        raise RuntimeError("the cascade did not end")
    return Cascade(levels)


def _depth(host: str) -> int:
    return host.count(".") + 1


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row. rules: (verdict, host, path beginning); a rule is
    named host + path; the longest fitting one decides, the default where none fits."""
    rules = sorted({(host.lower() + path, verdict, host.lower(), path) for verdict, host, path in rules})
    if len({r[0] for r in rules}) != len(rules):
        raise ValueError("a rule has two verdicts")
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url_col}`"))
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    # longest first; the key of a shape is null where the url is too short for it
    shapes = sorted({(len(h) + len(p), _depth(h), len(p)) for _, _, h, p in rules}, reverse=True)
    shapes = list(dict.fromkeys((d, n) for _, d, n in shapes))
    keys = [F.when((F.size(F.split("host", r"\.")) >= d) & (F.length("path") >= n) & (F.col("host") != ""),
                   F.concat(F.substring_index("host", ".", -d), F.substring("path", 1, n))) for d, n in shapes]
    verdicts = sorted({v for _, v, _, _ in rules})
    found: list[tuple[int, str, Column]] = []
    judged = urls.withColumn("keys", F.array(*keys) if keys else F.array().cast("array<string>"))
    if rules:
        universe = stored(judged.select(F.explode("keys").alias("key")).filter("key is not null").distinct(), "cascade-universe")
    turn = 0
    for verdict in verdicts:
        names = [r[0] for r in rules if r[1] == verdict]
        for at in range(0, len(names), TURN_KEYS):
            listed = spark.createDataFrame([(n,) for n in names[at:at + TURN_KEYS]], "key string")
            judged = _mark(judged, build(universe, listed), f"turn{turn}", len(shapes))
            found += [(i, verdict, F.col(f"turn{turn}")[i]) for i in range(len(shapes))]
            turn += 1
    # the longest listed key of each url: its length, then its name, decide
    options = F.array(*[F.when(hit, F.struct((-F.length(F.col("keys")[i])).alias("length"), F.col("keys")[i].alias("rule"),
                                             F.lit(verdict).alias("verdict"))) for i, verdict, hit in found]) if found else None
    best = F.array_min(F.filter(options, lambda x: x.isNotNull())) if found else F.lit(None).cast(
        "struct<length:int,rule:string,verdict:string>")
    return (judged.withColumn("best", best)
            .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


def _mark(urls: DataFrame, cascade: Cascade, name: str, width: int) -> DataFrame:
    """Adds array column ``name``: which of the row's keys are listed."""
    shared = urls.sparkSession.sparkContext.broadcast(cascade.levels)
    levels = range(len(cascade.levels))
    hashes = F.array(*[F.array(*[h for level in levels for h in _hashes(F.col("keys")[i], level)]) for i in range(width)])

    def test(values):
        import pandas as pd

        known = Cascade(shared.value)
        for rows in values:
            flat = np.array([[list(k) for k in row] for row in rows], np.int64).reshape(len(rows) * width, 2 * len(levels))
            hits = known.test([(flat[:, 2 * k], flat[:, 2 * k + 1]) for k in levels]).reshape(len(rows), width)
            yield pd.Series(list(hits))

    marked = F.pandas_udf(_typed(test), "array<boolean>")(hashes)
    null_keys = F.transform("keys", lambda k: k.isNotNull())
    return urls.withColumn(name, F.zip_with(marked, null_keys, lambda a, b: a & b))


def _typed(function):
    """Gives the iterator function the type hints by which Spark knows its kind."""
    import pandas as pd
    from collections.abc import Iterator

    function.__annotations__ = {"values": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return function
