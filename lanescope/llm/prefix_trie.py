"""The trie of all conversations' beginnings, with the totals of every subtree.

Turns are sorted by conversation over range partitions, so that a conversation may span many of them.
The digest of a prefix is a polynomial of its turns' hashes modulo 2^127 - 1: partitions compute it from
their own rows, a prefix sum over one state a partition completes those that began before, and a
conversation that starts with another's turns takes that one's prefix digest by one multiplication.
Distinct digests are the nodes; their counts are summed before the shuffle, and a digest that stood for
two sequences would stop the job.

Subtree totals are sums over flat arrays: a shard's digests get slots of a minimal perfect hash (keys
kept and compared), counts are scattered into those slots, and values go up through the array of parent
slots, deepest first. A shard is a set of whole subtrees whose rows number at most ``SHARD``. The nodes
above are few; they are added up in blocks of ``BLOCK`` levels, with one short pass over the blocks'
tops in between, so that neither a hot first turn nor one endless conversation meets in one task.

Defined results: turns are taken in the order of turn (null first), then role, then the hash of role
and text, so that repeated rows are as many turns; a null role or text is empty; rows without conv_id
take no part; ``base % m`` of a negative id is Spark's; no conversations give no nodes; other columns are
not looked at. Words are counted in the whole text. ``ends_sha256`` hashes a node's ids in one stream, as a
SHA-256 must: that task reads them in fragments of up to 4,096 ids and holds one fragment.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stored
from .words import mixed

#: Rows below a node from which on it is not added up inside one shard.
SHARD = 1 << 17
#: Levels of the nodes above the shards that one task adds up.
BLOCK = 4096
#: Fixed values of the digest: modulus, base and its inverse; the root is the empty sequence.
_P = (1 << 127) - 1
_BASE = 0x5851F42D4C957F2D14057B7EF767814F
_BACK = pow(_BASE, -1, _P)
_ROOT = (1).to_bytes(16, "big")
#: Bits of an id inside one fragment of a node's ids.
_FRAGMENT = 12


class SlotTable:
    """A minimal perfect hash of distinct 16-byte keys (n x 2 numbers) with the keys kept in their slots."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.levels, slot, left, base = [], np.zeros(n, np.int64), np.arange(n), 0
        while len(left):
            if len(self.levels) == 100:
                raise ValueError("keys are repeated")
            m = 2 * len(left) + 1
            cell = self._cell(keys[left], m, len(self.levels))
            alone = np.bincount(cell, minlength=m) == 1
            rank = base + np.cumsum(alone) - alone
            mine = alone[cell]
            slot[left[mine]] = rank[cell[mine]]
            self.levels.append((alone, rank))
            base += int(alone.sum())
            left = left[~mine]
        self.slot, self.keys = slot, np.zeros_like(keys)
        self.keys[slot] = keys

    @staticmethod
    def _cell(keys: np.ndarray, m: int, level: int) -> np.ndarray:
        return (mixed(mixed(keys[:, 0] + np.uint64(level)) ^ keys[:, 1]) % np.uint64(m)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys, -1 for those not in the table."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            cell = self._cell(keys[todo], len(alone), level)
            hit = alone[cell]
            out[todo[hit]] = rank[cell[hit]]
            todo = todo[~hit]
        inside = np.flatnonzero(out >= 0)
        out[inside[(self.keys[out[inside]] != keys[inside]).any(axis=1)]] = -1
        return out


def add_up(digest: np.ndarray, parent: np.ndarray, depth: np.ndarray, *values: np.ndarray):
    """(parent's row or -1, rows that have it as parent, each value summed over the subtree), by row."""
    table = SlotTable(digest)
    up = np.full(len(digest), -1, np.int64)                   # by slot: the parent's slot
    up[table.slot] = table.find(parent)
    sums = [np.zeros(len(digest), np.int64) for _ in values]
    for total, v in zip(sums, values):
        total[table.slot] = v
    children = np.bincount(up[up >= 0], minlength=len(digest))
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(table.slot[order], cuts):           # deepest first
        level = level[up[level] >= 0]
        for total in sums:
            np.add.at(total, up[level], total[level])
    row = np.zeros(len(digest), np.int64)
    row[table.slot] = np.arange(len(digest))
    above = up[table.slot]
    return np.where(above >= 0, row[above], -1), children[table.slot], *(t[table.slot] for t in sums)


# -- prefixes ------------------------------------------------------------------------------


def _number(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def _binary(numbers) -> list[bytes]:
    return [x.to_bytes(16, "big") for x in numbers]


def _sorted_turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A stored table (conv_id, part, k, here, key, words): the k-th turn of the conversation among the
    rows of partition ``part`` and the digest of those turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "key"]
    turns = (conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256),
                            1, 32)).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
        .repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "words"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, conv, k, here = TaskContext.get().partitionId(), None, 0, 1
        for batch in batches:
            n, digests = [], []
            for c, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c != conv:
                    conv, k, here = c, 0, 1
                k, here = k + 1, (here * _BASE + _number(key)) % _P
                n.append(k)
                digests.append(here)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([part] * len(n), pa.int32()), pa.array(n, pa.int64()),
                pa.array(_binary(digests), pa.binary()), batch.column(1), batch.column(2)],
                ["conv_id", "part", "k", "here", "key", "words"])

    return stored(turns.mapInArrow(run, "conv_id long, part int, k long, here binary, key binary, words long"), "trie-turns")


def _carried(turns: DataFrame) -> dict[int, tuple[int, int, int]]:
    """part -> (conversation, turns, digest) of what partitions before hold of its first conversation. Two
    states a partition go through the driver."""
    state = lambda c: F.max(F.struct(c.alias("order"), "conv_id", "k", "here"))
    ends = turns.groupBy("part").agg(state(F.bitwise_not("conv_id")).alias("first"), state(F.col("conv_id")).alias("last")).collect()
    out, conv, k, digest = {}, None, 0, 1
    for e in sorted(ends, key=lambda e: e.part):
        more, here = e.first.k, _number(bytes(e.first.here))
        if e.first.conv_id == conv:
            out[e.part] = (conv, k, digest)
            more, here = k + more, _shifted(here, digest, more)
        if e.last.conv_id != e.first.conv_id:
            more, here = e.last.k, _number(bytes(e.last.here))
        conv, k, digest = e.last.conv_id, more, here
    return out


def _shifted(here: int, before: int, k: int) -> int:
    """The digest of a sequence with digest ``before`` followed by the k turns of ``here``."""
    return (here + (before - 1) * pow(_BASE, k, _P)) % _P


def _whole(turns: DataFrame) -> DataFrame:
    """(conv_id, k, here, key, words) with places and digests of the whole conversations."""
    carried = _carried(turns)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            conv, part, k, here = (batch.column(i).to_pylist() for i in range(4))
            for i, p in enumerate(part):
                if p in carried and carried[p][0] == conv[i]:
                    here[i] = _shifted(_number(here[i]), carried[p][2], k[i]).to_bytes(16, "big")
                    k[i] += carried[p][1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k, pa.int64()), pa.array(here, pa.binary()),
                                              batch.column(4), batch.column(5)], ["conv_id", "k", "here", "key", "words"])

    return turns.mapInArrow(run, "conv_id long, k long, here binary, key binary, words long")


def prefixes(conversations: DataFrame, base: Callable[[Column], Column] | None = None,
             shared: Callable[[Column], Column] | None = None, most_shared: int = 0, id_col: str = "conv_id",
             turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (conv_id, length) of every conversation, and a row per conversation and depth
    (conv_id, depth, digest, parent, key, words, below: turns that follow).

    base, shared: from the id, the conversation whose first ``shared`` (0 to ``most_shared``) original turns
    stand in the place of the conversation's own first ones; all of them if it has fewer, none if it is absent."""
    turns = _whole(_sorted_turns(conversations, id_col, turn_col, role_col, text_col))
    head = F.struct("k", "here", "key", "words")
    convs = stored(turns.groupBy("conv_id").agg(
        F.max("k").alias("n"), F.sort_array(F.collect_list(F.when(F.col("k") <= most_shared, head))).alias("head")), "trie-heads")
    if base is None:
        convs = convs.withColumns({"h": F.lit(0).cast("long"), "taken": F.slice("head", 1, 0)})
    else:
        heads = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
        convs = (convs.withColumns({"h": shared(F.col("conv_id")).cast("long"), "base": base(F.col("conv_id"))})
                 .join(heads, "base", "left")
                 .withColumn("taken", F.coalesce(F.slice("base_head", 1, F.col("h").cast("int")), F.slice("head", 1, 0))))
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1)["here"])
    convs = stored(convs.select(
        "conv_id", "h", F.size("taken").cast("long").alias("lead"), "taken", last(F.col("taken")).alias("before"),
        last(F.slice("head", 1, F.col("h").cast("int"))).alias("own"),
        (F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")
    taken = convs.select("conv_id", "length", F.explode("taken").alias("t")).select(
        "conv_id", "length", F.col("t.k").alias("depth"), F.lit(0).cast("long").alias("power"), "t.here", "t.key", "t.words",
        F.lit(None).cast("binary").alias("before"), F.lit(None).cast("binary").alias("own"))
    own = (turns.join(small_side(convs.select("conv_id", "length", "h", "lead", "before", "own")), "conv_id")
           .filter(F.col("k") > F.col("h"))
           .select("conv_id", "length", (F.col("k") - F.col("h") + F.col("lead")).alias("depth"), (F.col("k") - F.col("h")).alias("power"),
                   "here", "key", "words", "before", "own"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            power, here, key, before, replaced = (batch.column(i).to_pylist() for i in (3, 4, 5, 7, 8))
            digest = [_number(x) for x in here]
            for i, (b, o) in enumerate(zip(before, replaced)):
                if b is not None or o is not None:            # other first turns than its own
                    change = (_number(b) if b else 1) - (_number(o) if o else 1)
                    digest[i] = (digest[i] + change * pow(_BASE, power[i], _P)) % _P
            parent = [(d - _number(t)) * _BACK % _P for d, t in zip(digest, key)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(_binary(digest), pa.binary()), pa.array(_binary(parent), pa.binary()),
                batch.column(5), batch.column(6), pa.array(batch.column(1).to_numpy() - batch.column(2).to_numpy())],
                ["conv_id", "depth", "digest", "parent", "key", "words", "below"])

    rows = taken.union(own).mapInArrow(
        run, "conv_id long, depth long, digest binary, parent binary, key binary, words long, below long")
    return convs.select("conv_id", "length"), stored(rows, "trie-rows")


# -- nodes ---------------------------------------------------------------------------------


def _nodes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(digest, parent, depth, conv_id, n_convs, saved, below): the distinct prefixes, the root too."""
    same = F.lit(True)
    for c in ("depth", "parent", "key"):
        same = same & (F.min(c) == F.max(c))
    found = rows.groupBy("digest").agg(
        F.when(same, F.min("parent")).otherwise(F.raise_error(F.lit("two prefixes share a digest"))).alias("parent"),
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        ((F.count("*") - 1) * F.max("words")).alias("saved"), F.sum("below").alias("below"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("length").alias("below")).filter(
        "n_convs > 0").select(F.lit(_ROOT).alias("digest"), F.lit(b"").alias("parent"), F.lit(0).cast("long").alias("depth"),
                              "conv_id", "n_convs", F.lit(0).cast("long").alias("saved"), "below")
    return stored(found.unionByName(root), "trie-nodes")


def _keys(column) -> np.ndarray:
    return np.frombuffer(b"".join(x.rjust(16, b"\0") for x in column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)


_TOTALS = "digest binary, parent binary, depth long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"


def _light(nodes: DataFrame, shard: int) -> DataFrame:
    """``_TOTALS`` of the subtrees named by ``top``; parent_conv_id is null at their tops."""

    def fold(table):
        import pyarrow as pa

        digest, parent = _keys(table.column("digest")), _keys(table.column("parent"))
        depth, conv, below, saved = (table.column(c).to_numpy() for c in ("depth", "conv_id", "below", "saved"))
        up, children, leaves, saved = add_up(digest, parent, depth, (below == 0).astype(np.int64), saved)
        out = pa.table({"digest": table.column("digest"), "parent": table.column("parent"), "depth": table.column("depth"),
                        "conv_id": table.column("conv_id"), "n_convs": table.column("n_convs"),
                        "parent_conv_id": pa.array(conv[up], mask=up < 0), "n_children": children, "n_leaves": leaves,
                        "saved_tokens": saved})
        return out.to_batches()

    def run(batches):
        import pyarrow as pa

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= shard:
                table = pa.Table.from_batches(held).combine_chunks()
                top = _keys(table.column("top"))
                whole = np.flatnonzero((top[1:] != top[:-1]).any(axis=1))      # where the last top begins
                if len(whole):
                    cut = int(whole[-1]) + 1
                    yield from fold(table.slice(0, cut))
                    table = table.slice(cut)
                held, rows = table.to_batches(), table.num_rows
        if rows:
            yield from fold(pa.Table.from_batches(held).combine_chunks())

    return nodes.repartition("top").sortWithinPartitions("top").mapInArrow(run, _TOTALS)


def _heavy(nodes: DataFrame, block: int) -> DataFrame:
    """``_TOTALS`` (without the parents' ids) of the nodes above the shards; nodes: with ``leaves``, ``saved`` and ``children``, what they have
    of their own and from the shards below them."""
    nodes = stored(nodes.withColumn("block", F.floor(F.col("depth") / block)), "trie-heavy")

    def local(batches):
        """Each block's sums, and the row of the block's top above each node."""
        import pyarrow as pa

        for table in _groups(batches):
            depth, digest = table.column("depth").to_numpy(), table.column("digest")
            up, children, leaves, saved = add_up(_keys(digest), _keys(table.column("parent")), depth,
                                                 table.column("leaves").to_numpy(), table.column("saved").to_numpy())
            top = np.arange(len(up))
            for i in np.argsort(depth, kind="stable").tolist():
                if up[i] >= 0:
                    top[i] = top[up[i]]
            yield from pa.table({
                "digest": digest, "parent": table.column("parent"), "top": digest.take(pa.array(top)), "block": table.column("block"),
                "is_top": pa.array(up < 0), "leaves": leaves, "saved": saved}).to_batches()

    grouped = nodes.repartition("block").sortWithinPartitions("block")
    first = stored(grouped.mapInArrow(local, "digest binary, parent binary, top binary, block long, is_top boolean, leaves long, saved long"),
                   "trie-blocks")
    tops = first.filter("is_top")
    above = small_side(first.select(F.col("digest").alias("parent"), F.col("top").alias("parent_top")))
    tops = tops.join(above, "parent", "left").select(
        "digest", "parent", F.coalesce("parent_top", F.lit(b"")).alias("parent_top"), "block", "leaves", "saved")

    def solve(batches):
        """Sums over whole subtrees at the blocks' tops."""
        import pyarrow as pa

        batches = list(batches)
        if batches:
            table = pa.Table.from_batches(batches).combine_chunks()
            _, _, leaves, saved = add_up(_keys(table.column("digest")), _keys(table.column("parent_top")), table.column("block").to_numpy(),
                                         table.column("leaves").to_numpy(), table.column("saved").to_numpy())
            yield from pa.table({"parent": table.column("parent"), "leaves": leaves, "saved": saved}).to_batches()

    below = (tops.repartition(1).mapInArrow(solve, "parent binary, leaves long, saved long").groupBy(F.col("parent").alias("digest"))
             .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("more_children")))
    more = lambda c: (F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c)
    nodes = nodes.join(below, "digest", "left").select("digest", "parent", "depth", "conv_id", "n_convs", "block",
                                                       more("leaves"), more("saved"), more("children"))

    def final(batches):
        import pyarrow as pa

        for table in _groups(batches):
            up, children, leaves, saved = add_up(_keys(table.column("digest")), _keys(table.column("parent")), table.column("depth").to_numpy(),
                                                 table.column("leaves").to_numpy(), table.column("saved").to_numpy())
            yield from pa.table({c: table.column(c) for c in ("digest", "parent", "depth", "conv_id", "n_convs")} | {
                "parent_conv_id": pa.nulls(len(up), pa.int64()), "n_children": children + table.column("children").to_numpy(),
                "n_leaves": leaves, "saved_tokens": saved}).to_batches()

    return nodes.repartition("block").sortWithinPartitions("block").mapInArrow(final, _TOTALS)


def _groups(batches):
    """One table per block from batches sorted by block."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    for batch in batches:
        blocks = batch.column(batch.schema.get_field_index("block"))
        for b in pc.unique(blocks).to_pylist():
            part = batch.filter(pc.equal(blocks, b))
            if held and held[0][0] != b:
                yield pa.Table.from_batches([x for _, x in held]).combine_chunks()
                held = []
            held.append((b, part))
    if held:
        yield pa.Table.from_batches([x for _, x in held]).combine_chunks()


def _ends(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the nodes at which conversations end."""
    ends = rows.filter("below = 0").select("digest", "conv_id").union(
        convs.filter("length = 0").select(F.lit(_ROOT), "conv_id"))
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    fragments = ends.groupBy("digest", F.shiftright("conv_id", _FRAGMENT).alias("fragment")).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches):
        import hashlib

        import pyarrow as pa

        node, sha = None, None
        for batch in batches:
            done = []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest == node:
                    sha.update(b"," + text.encode())
                else:
                    if node is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = digest, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())],
                                             ["digest", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["digest", "ends_sha256"])

    return (fragments.repartition("digest").sortWithinPartitions("digest", "fragment").select("digest", "ids")
            .mapInArrow(run, "digest binary, ends_sha256 string"))


def trie(convs: DataFrame, rows: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """One row per node of the tables of ``prefixes``: digest, parent, conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes = _nodes(convs, rows)
    is_heavy = (F.col("below") > shard) | (F.col("depth") == 0)
    heavy = stored(nodes.filter(is_heavy), "trie-above")
    few = small_side(heavy.select("digest", "conv_id"))
    # each conversation's deepest node above the shards, then the top of its shard's subtree
    cuts = rows.select("conv_id", "depth", "digest").join(few.select("digest"), "digest", "left_semi").groupBy("conv_id").agg(F.max("depth").alias("cut"))
    tops = (rows.select("conv_id", "depth", F.col("digest").alias("top")).join(cuts, "conv_id", "left")
            .filter(F.col("depth") == F.coalesce("cut", F.lit(0)) + 1).select("conv_id", "top"))
    light = stored(_light(nodes.filter(~is_heavy).join(tops, "conv_id"), shard), "trie-light")
    given = light.filter("parent_conv_id IS NULL").groupBy(F.col("parent").alias("digest")).agg(
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("more"), F.count("*").alias("children"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    above = _heavy(heavy.join(given, "digest", "left").select(
        "digest", "parent", "depth", "conv_id", "n_convs", (none("leaves") + (F.col("below") == 0).cast("long")).alias("leaves"),
        (F.col("saved") + none("more")).alias("saved"), none("children").alias("children")), block)
    parents = few.select(F.col("digest").alias("parent"), F.col("conv_id").alias("above_id"))
    totals = light.union(above).join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_id"))
    return totals.join(_ends(convs, rows), "digest", "left").select(
        "digest", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
