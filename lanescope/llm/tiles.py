"""Links between rows that share a bucket, found without a row for every pair.

A bucket's members are compared in tiles: one job holds at most two tiles of about ``tile`` members, so no
group has to fit into one task, and a pair becomes a row only when it is confirmed and joins two groups
of its job that were apart. Each job first compares fixed-size sketches; only members with a partner
that the sketches do not rule out get their data (shingle sets, texts) sent for the full comparison.

Buckets of more than one tile first compare every member with one representative, so that groups of
near copies become one component in linear work; pairs inside a component are settled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, stored
from .graph import components

#: Members a tile.
TILE = 512
_JOB = ["bucket", "i", "j"]


def whole_runs(batches, keys: int):
    """Tables that hold whole runs of rows with equal values in the first ``keys`` columns (longs, sorted)."""
    import pyarrow as pa

    rest = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(k) for k in range(keys)]
        if rest and any(rest[-1].column(k)[-1] != own[k][0] for k in range(keys)):
            yield pa.Table.from_batches(rest)
            rest = []
        own = np.stack([c.to_numpy() for c in own])
        starts = np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1
        if len(starts):
            yield pa.Table.from_batches([*rest, batch.slice(0, starts[-1])])
            rest = [batch.slice(starts[-1])]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _jobs(table, width: int):
    """(bucket, rows of the table, ids, components, sketches, first side or None) of each job."""
    own = np.stack([table.column(k).to_numpy() for k in range(3)])
    cuts = np.r_[0, np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1, own.shape[1]]
    side, ids, comp = (table.column(k).to_numpy() for k in (3, 4, 5))
    sketches = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint8).reshape(-1, width)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        two = own[1, a] != own[2, a]
        yield own[0, a], slice(a, b), ids[a:b], comp[a:b], sketches[a:b], (side[a:b] == own[1, a]) if two else None


def _mask(bucket, ids, comp, sketches, first, select) -> np.ndarray:
    """Pairs (row, row) of a job that are worth the full comparison, each once."""
    mask = select(bucket, sketches)
    mask &= comp[:, None] != comp[None, :]
    mask &= np.triu(np.ones_like(mask), 1) if first is None else first[:, None] & ~first[None, :]
    return mask


def tile_links(buckets: DataFrame, width: int, select: Callable, data: Callable[[DataFrame], DataFrame],
               prepare: Callable, tile: int = TILE) -> DataFrame:
    """(node, component) of all nodes with a link.

    buckets: a stored table (bucket long, id long, sketch binary of ``width`` bytes) without repeats.
    select(bucket, sketches): matrix of the pairs that may be similar; it may leave out a pair in a
    bucket if the pair meets in another one too. data(ids): (id, data binary) of a table of ids.
    prepare(list of data): a function (k, others) -> which of the others are similar to k.
    """
    rows = buckets.select("bucket", "id", F.col("id").alias("comp"), "sketch")
    large = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile)
                   .select(F.col("bucket").alias("large"), F.ceil(F.col("n") / tile).cast("long").alias("tiles")), "large-buckets")
    many = large.count()
    found = comp = None
    if many:
        hot = rows.join(small_side(large, many), F.col("bucket") == F.col("large"))
        own = F.pmod(F.xxhash64("id"), F.col("tiles"))
        leader = hot.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id", "comp", "sketch", "tiles")).alias("r"))
        jobs = hot.select("bucket", own.alias("i"), F.lit(-1).cast("long").alias("j"), own.alias("side"), "id", "comp", "sketch").union(
            leader.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r.tiles") - 1)).alias("i"), F.lit(-1).cast("long").alias("j"),
                          F.lit(-1).cast("long").alias("side"), "r.id", "r.comp", "r.sketch"))
        found = _confirmed(jobs, width, select, data, prepare)
        comp = stored(components(found), "tile-components")
        rows = rows.join(small_side(comp), F.col("id") == F.col("node"), "left").select(
            "bucket", "id", F.coalesce("component", "id").alias("comp"), "sketch")
    zero = F.lit(0).cast("long")
    if many:
        rows = rows.join(small_side(large, many), F.col("bucket") == F.col("large"), "left")
        own = F.coalesce(F.pmod(F.xxhash64("id"), F.col("tiles")), zero)
        other = F.explode(F.sequence(zero, F.coalesce(F.col("tiles"), F.lit(1)) - 1))
        rows = rows.select("bucket", own.alias("side"), other.alias("other"), "id", "comp", "sketch").select(
            "bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "comp", "sketch")
    else:
        rows = rows.select("bucket", zero.alias("i"), zero.alias("j"), zero.alias("side"), "id", "comp", "sketch")
    last = _confirmed(rows, width, select, data, prepare)
    return components(last if comp is None else last.union(comp.select("node", "component")))


def _confirmed(jobs: DataFrame, width: int, select, data, prepare) -> DataFrame:
    """(a, b): links that connect what the jobs' similar pairs connect."""
    schema = "bucket long, i long, j long, side long, id long, comp long, sketch binary"

    def worth(batches):
        for table in whole_runs(batches, 3):
            keep = np.zeros(table.num_rows, bool)
            for bucket, at, ids, comp, sketches, first in _jobs(table, width):
                mask = _mask(bucket, ids, comp, sketches, first, select)
                keep[at] = mask.any(axis=0) | mask.any(axis=1)
            yield from table.take(np.flatnonzero(keep)).to_batches()

    left = stored(jobs.repartition(*_JOB).sortWithinPartitions(*_JOB).mapInArrow(worth, schema), "tile-jobs")
    own = data(left.select("id").distinct()).select(F.col("id").alias("owner"), "data")

    def compare(batches):
        import pyarrow as pa

        for table in whole_runs(batches, 3):
            a, b = [], []
            contents = table.column(7)
            for bucket, at, ids, comp, sketches, first in _jobs(table, width):
                mask = _mask(bucket, ids, comp, sketches, first, select)
                similar, group = prepare(contents.slice(at.start, at.stop - at.start).to_pylist()), comp.copy()
                for k in range(len(ids)):
                    others = np.flatnonzero(mask[k] & (group != group[k]))
                    if len(others):
                        for o in others[similar(k, others)].tolist():
                            if group[o] != group[k]:
                                a.append(int(ids[k]))
                                b.append(int(ids[o]))
                                group[group == group[o]] = group[k]
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    full = left.join(own, F.col("id") == F.col("owner")).select(*left.columns, "data")
    return stored(full.repartition(*_JOB).sortWithinPartitions(*_JOB).mapInArrow(compare, "a long, b long"), "tile-links")
