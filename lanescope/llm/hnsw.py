"""Embedding near-duplicates by hierarchical navigable small-world (HNSW) graphs.

Vectors are compared only inside their label. Equal vectors are one node with a count. A label's nodes
are spread over shards by a hash; a task builds one shard's graph. Then every shard is queried with
the nodes of every shard of its label (each pair of shards once): a beam search finds the
neighbourhood, from which the search floods along the graph through all nodes that are similar
enough; the cosine of each is computed in double precision. Recall audits compare a spread of the queries
with a scan of the shard; beams widen until the audit passes, and at the width of the whole
shard the scan itself answers. Links inside a cell become one row a node: its links and the smallest
node of its local component; components over all cells follow from these by joins.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a
null label or a null id link with nothing and are their own component; vectors of different lengths do not
link; repeated rows count as vectors of their own; an id with several vectors does not join them; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, stored
from .graph import components
from .vectors import matrix, usable

THRESHOLD = 0.98
#: Nodes a shard is meant to hold; a task holds two shards.
SHARD = 4096
DEGREE, BEAM = 12, 48            # links a node and level (twice at the ground); width while building
SLACK = 0.02                     # the flood also passes nodes this much below the threshold
AUDIT, RECALL = 64, 0.99         # queries compared with a scan; the recall they must show


class Graph:
    """An HNSW graph over unit vectors. Ground-level links are one integer matrix (-1: none)."""

    def __init__(self, unit: np.ndarray, ground: np.ndarray | None = None, upper: list | None = None):
        self.unit, self.n = unit, len(unit)
        self.ground = np.full((self.n, 2 * DEGREE), -1, np.int32) if ground is None else ground
        self.upper = [] if upper is None else upper     # per level from 1: {node: list of nodes}
        self.entry = next(iter(self.upper[-1])) if self.upper else 0

    # -- search ----------------------------------------------------------------------------

    def _near(self, node: int, level: int):
        if level:
            return self.upper[level - 1].get(node, ())
        row = self.ground[node]
        return row[row >= 0].tolist()

    def _beam(self, q: np.ndarray, start: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest found: (similarity, node), nearest first."""
        sims = (self.unit[start] @ q).tolist()
        seen = set(start)
        ahead = [(-s, x) for s, x in zip(sims, start)]
        best = [(s, x) for s, x in zip(sims, start)]
        heapq.heapify(ahead)
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while ahead:
            s, x = heapq.heappop(ahead)
            if len(best) >= width and -s < best[0][0]:
                break
            new = [y for y in self._near(x, level) if y not in seen]
            if not new:
                continue
            seen.update(new)
            for t, y in zip((self.unit[new] @ q).tolist(), new):
                if len(best) < width:
                    heapq.heappush(best, (t, y))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, y))
                else:
                    continue
                heapq.heappush(ahead, (-t, y))
        return sorted(best, reverse=True)

    def _descend(self, q: np.ndarray, down_to: int) -> list[int]:
        at = [self.entry]
        for level in range(len(self.upper), down_to, -1):
            at = [self._beam(q, at, 1, level)[0][1]]
        return at

    def within(self, q: np.ndarray, threshold: float, width: int) -> np.ndarray:
        """Nodes found with a similarity of at least ``threshold``."""
        if width >= self.n:
            return np.flatnonzero(self.unit @ q >= threshold)
        found = self._beam(q, self._descend(q, 0), width, 0)
        ahead = np.array([x for s, x in found if s >= threshold - SLACK], np.int64)
        seen = np.zeros(self.n, bool)
        seen[ahead] = True
        reached = [ahead]
        while len(ahead):
            new = np.unique(self.ground[ahead])
            new = new[new >= 0]
            new = new[~seen[new]]
            seen[new] = True
            ahead = new[self.unit[new] @ q >= threshold - SLACK]
            reached.append(ahead)
        near = np.concatenate(reached)
        return near[(self.unit[near] * q).sum(axis=1) >= threshold]

    # -- build -----------------------------------------------------------------------------

    def _choose(self, q: np.ndarray, nodes: list[int], sims: list[float], most: int) -> list[int]:
        """Neighbours in different directions first: a node counts if it is nearer to q than to any
        chosen one; the nearest of the others fill up."""
        if len(nodes) <= most:
            return nodes
        order = np.argsort(-np.asarray(sims), kind="stable")
        some = np.asarray(nodes)[order]
        mutual = self.unit[some] @ self.unit[some].T
        own = np.asarray(sims)[order]
        kept: list[int] = []
        closest = np.full(len(some), -2.0)
        for i in range(len(some)):
            if own[i] > closest[i]:
                kept.append(i)
                if len(kept) == most:
                    break
                np.maximum(closest, mutual[i], out=closest)
        if len(kept) < most:
            chosen = set(kept)
            kept += [i for i in range(len(some)) if i not in chosen][:most - len(kept)]
        return some[kept].tolist()

    def _link(self, node: int, new: int, level: int) -> None:
        most = DEGREE if level else 2 * DEGREE
        own = list(self._near(node, level)) + [new]
        if len(own) > most:
            own = self._choose(self.unit[node], own, (self.unit[own] @ self.unit[node]).tolist(), most)
        self._set(node, own, level)

    def _set(self, node: int, links: list[int], level: int) -> None:
        if level:
            self.upper[level - 1][node] = links
        else:
            self.ground[node] = -1
            self.ground[node, :len(links)] = links

    def build(self, heights: np.ndarray) -> Graph:
        """Insert all nodes in order; heights: the top level of each."""
        for x in range(self.n):
            q, height = self.unit[x], int(heights[x])
            if x:
                at = self._descend(q, height)
                for level in range(min(height, len(self.upper)), -1, -1):
                    found = self._beam(q, at, BEAM, level)
                    at = [y for _, y in found]
                    links = self._choose(q, at, [s for s, _ in found], DEGREE)
                    self._set(x, links, level)
                    for y in links:
                        self._link(y, x, level)
            while len(self.upper) < height:
                self.upper.append({x: []})
                self.entry = x
        return self

    def pack(self) -> dict[str, np.ndarray]:
        rows = [(level, node, *links, *[-1] * (DEGREE - len(links)))
                for level, nodes in enumerate(self.upper) for node, links in nodes.items()]
        return {"ground": self.ground, "upper": np.array(rows, np.int32).reshape(-1, DEGREE + 2)}

    @staticmethod
    def unpack(unit: np.ndarray, ground: np.ndarray, upper: np.ndarray) -> Graph:
        levels: list[dict] = [{} for _ in range(int(upper[:, 0].max()) + 1)] if len(upper) else []
        for level, node, *links in upper.tolist():
            levels[level][node] = [y for y in links if y >= 0]
        return Graph(unit, ground, levels)


def heights(ids: np.ndarray) -> np.ndarray:
    """The top level of each node, drawn from its id."""
    x = (ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return np.minimum((-np.log(u) / math.log(DEGREE)).astype(np.int64), 8)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def neighbours(graph: Graph, queries: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix queries x nodes. Beams widen until the audit passes."""
    width, n = 32, len(queries)
    audit = np.unique(np.linspace(0, n - 1, min(n, AUDIT)).astype(np.int64))
    truth = queries[audit] @ graph.unit.T >= threshold
    while True:
        hits = np.zeros((n, graph.n), bool)
        got = 0
        for k in audit:
            hits[k, graph.within(queries[k], threshold, width)] = True
        got, want = int((hits[audit] & truth).sum()), int(truth.sum())
        if got >= RECALL * want or width >= graph.n:
            break
        width *= 2
    for k in np.setdiff1d(np.arange(n), audit):
        hits[k, graph.within(queries[k], threshold, width)] = True
    return hits


def local_components(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and columns of a bipartite adjacency matrix (-1: no link)."""
    rows, cols = np.full(hits.shape[0], -1), np.full(hits.shape[1], -1)
    for first in np.flatnonzero(hits.any(axis=1)):
        if rows[first] >= 0:
            continue
        ahead = np.array([first])
        rows[first] = first
        while len(ahead):
            new = np.flatnonzero(hits[ahead].any(axis=0) & (cols < 0))
            cols[new] = first
            ahead = np.flatnonzero(hits[:, new].any(axis=1) & (rows < 0)) if len(new) else new
            rows[ahead] = first
    return rows, cols


def _load(blob: bytes):
    with np.load(io.BytesIO(blob)) as f:
        ids, counts, vectors, ground, upper = (f[k] for k in ("ids", "counts", "vectors", "ground", "upper"))
    unit = unit_rows(vectors.astype(np.float64))
    return ids, counts, unit, ground, upper


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fits = usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    key = F.when(fits, F.unhex(F.md5(F.concat_ws(",", F.col("v").cast("array<string>")))))
    # vectors of different lengths have no cosine: a label's vectors of each length are a label of their own
    rows = rows.withColumn("key", key).withColumn("label", F.concat_ws(" ", F.size("v"), "label"))
    marked = stored(rows.select("id", "label", "key"), "hnsw-rows")
    # equal vectors are one node, with a number of its own, as an id may occur with several vectors
    nodes = rows.filter("key is not null").groupBy("label", "key").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "hnsw-nodes")
    sizes = nodes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    sizes = stored(sizes, "hnsw-labels")
    total = sizes.agg(F.sum("shards").alias("s"), F.sum(F.col("shards") * (F.col("shards") + 1) / 2).alias("c")).first()
    shards, cells = int(total.s or 0), int(total.c or 0)
    spread = nodes.join(small_side(sizes), "label").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values("node")
        ids = pdf["node"].to_numpy()
        vectors = np.array(pdf["v"].tolist(), np.float64)
        graph = Graph(unit_rows(vectors)).build(heights(ids))
        out = io.BytesIO()
        np.savez(out, ids=ids, counts=pdf["n"].to_numpy(), vectors=vectors, **graph.pack())
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "graph": [out.getvalue()]})

    # small data, much work: as many tasks as shards, which must not be merged again
    parts = max(1, min(4 * shards, 20_000))
    graphs = stored(spread.select("label", "shard", "node", "n", "v").repartition(parts, "label", "shard")
                    .groupBy("label", "shard").applyInPandas(build, "label string, shard int, graph binary"), "hnsw-graphs")

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column(0)[k].as_py()
                x_ids, x_counts, x_unit, x_ground, x_upper = _load(batch.column(1)[k].as_py())
                if same:
                    hits = neighbours(Graph.unpack(x_unit, x_ground, x_upper), x_unit, threshold)
                    hits |= hits.T
                    np.fill_diagonal(hits, False)
                    sides = [(x_ids, hits, x_counts)]
                    # a node is a row and a column here: its loop joins the two
                    numbers = [local_components(hits | np.eye(len(hits), dtype=bool))[0]]
                else:
                    y_ids, y_counts, y_unit, _, _ = _load(batch.column(2)[k].as_py())
                    hits = neighbours(Graph.unpack(x_unit, x_ground, x_upper), y_unit, threshold)
                    sides = [(y_ids, hits, x_counts), (x_ids, hits.T, y_counts)]
                    numbers = local_components(hits)
                ids = np.concatenate([s[0] for s in sides])
                n = np.concatenate([np.array([int(w[h].sum()) for h in m], np.int64) for _, m, w in sides])
                of = np.concatenate(list(numbers))
                linked = n > 0
                ids, n, of = ids[linked], n[linked], of[linked]
                lowest: dict = {}
                for c, i in zip(of.tolist(), ids.tolist()):
                    lowest[c] = min(i, lowest.get(c, i))
                yield pa.RecordBatch.from_pydict({"node": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()),
                                                  "peer": pa.array([lowest[c] for c in of.tolist()], pa.int64())})

    parts = max(1, min(4 * cells, 20_000))
    x, y = graphs.alias("x"), graphs.alias("y")
    pairs = (x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.shard") <= F.col("y.shard")))
             .select("x.label", F.col("x.shard").alias("i"), F.col("y.shard").alias("j"), (F.col("x.shard") == F.col("y.shard")).alias("same"),
                     F.col("x.graph").alias("xg"), F.when(F.col("x.shard") != F.col("y.shard"), F.col("y.graph")).alias("yg")))
    found = stored(pairs.repartition(parts, "label", "i", "j").select("same", "xg", "yg")
                   .mapInArrow(search, "node long, n long, peer long"), "hnsw-links")
    comp = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    per_node = nodes.select("label", "key", "node", "n", "least").join(
        found.groupBy("node").agg(F.sum("n").alias("links")), "node", "left").join(
        comp.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
    per_node = stored(per_node.select(F.col("label").alias("n_label"), F.col("key").alias("n_key"), "least",
                                      (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                                      F.coalesce("component", "node").alias("class")), "hnsw-classes")
    first = per_node.groupBy("class").agg(F.min("least").alias("component"))
    per_node = stored(per_node.join(first, "class").select("n_label", "n_key", "links", "component"), "hnsw-result")
    joined = marked.join(small_side(per_node), (F.col("label") == F.col("n_label")) & (F.col("key") == F.col("n_key")), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
