"""Links by tiles against all pairs."""

import numpy as np
import pytest

from lanescope.llm import icws
from lanescope.llm.common import importable, stored
from lanescope.llm.tiles import tile_links, whole_runs


def components_of(n, linked):
    group = list(range(n))
    for a in range(n):
        for b in range(a):
            if group[a] != group[b] and linked(a, b):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return group


def test_whole_runs_never_cut_a_run():
    import pyarrow as pa

    key = np.sort(np.random.default_rng(5).integers(0, 12, 200))
    batch = pa.RecordBatch.from_pydict({"k": key, "two": key // 3, "at": np.arange(200)})
    for size in (1, 3, 50, 200):
        runs = [t.column(0).to_numpy() for t in whole_runs([batch.slice(a, size) for a in range(0, 200, size)], 2)]
        assert np.concatenate(runs).tolist() == key.tolist()
        assert all(x[-1] != y[0] for x, y in zip(runs, runs[1:]))
    assert not list(whole_runs([batch.slice(0, 0)], 2))


@pytest.mark.parametrize("tile", [8, 4096])
def test_tile_links_equal_all_pairs(spark, tile):
    """Numbers linked if at most 2 apart, in buckets of ten and of seven, one bucket of them all."""
    importable(spark)
    values = [int(v) for v in np.random.default_rng(6).integers(0, 900, 150)]
    rows = [(b, k, np.int64(v).tobytes()) for k, v in enumerate(values) for b in (0, 1 + v // 10, 1000 + v // 7)]
    buckets = stored(spark.createDataFrame(rows, "bucket long, id long, sketch binary"), "test-buckets")
    numbers = spark.createDataFrame([(k, np.int64(v).tobytes()) for k, v in enumerate(values)], "node long, data binary")

    def select(bucket, sketches):
        own = np.ascontiguousarray(sketches).view(np.int64)[:, 0]
        return abs(own[:, None] - own[None, :]) <= 5

    def prepare(raw):
        own = np.frombuffer(b"".join(raw), np.int64)
        return lambda k, others: abs(own[others] - own[k]) <= 2

    def data(ids):
        return numbers.join(ids, numbers.node == ids.id).select("id", "data")

    want = components_of(len(values), lambda a, b: abs(values[a] - values[b]) <= 2)
    got = {r.node: r.component for r in tile_links(buckets, 8, select, data, prepare, tile).collect()}
    assert [got.get(k, k) for k in range(len(values))] == want
    assert not tile_links(buckets.limit(0), 8, select, data, prepare, tile).count()


def test_icws_tiles_find_all_pairs_of_a_bucket(spark, monkeypatch):
    """Copies of many degrees in small tiles; one set with many others equals set with set."""
    monkeypatch.setattr(icws, "TILE", 8)
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(90):
        own = list(words)
        for p in rng.choice(120, int(rng.integers(0, 7)), False):
            own[p] = f"x{rng.integers(10_000)}"
        texts.append(" ".join(own))
    importable(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known, idf = icws.WordHashes(), icws.inverse_frequencies(docs)
    sets = [icws.weighted_set(t, idf, known) for t in texts]
    similar = icws.compared(0.8)([k.tobytes() + w.tobytes() for k, w in sets])
    others = np.arange(90)
    assert similar(0, others).tolist() == [icws.similarity(sets[0], s) >= 0.8 for s in sets]
    want = components_of(90, lambda a, b: icws.similarity(sets[a], sets[b]) >= 0.8)
    assert [r.class_id for r in sorted(icws.groups(docs).collect())] == want
