"""Repair of conversations whose roles must alternate, by the auction shortest-path algorithm.

A conversation's edits are a path through a lattice of its turns and four role states (start, after
the system turn, after a user turn, after an assistant turn). Arcs keep a turn (0), give it another
role (3), delete it (4; the only choice for a blank or repeated turn) or insert an empty turn (3); a
truncated turn that stays costs 3 more. Node prices start at a consistent lower bound; a path from the
origin is extended along the cheapest arc while the price of its end allows it, else that price is
raised and the path contracted. Prices on every cheapest path are then exact, so the arcs that are tight and
lead to exact nodes are the cheapest edits, and the letters' smallest sequence is traced along them.
Long conversations are solved in windows of ``WINDOW`` turns from the last to the first; exact prices at
a window's entry are the costs at the exit of the window before.

Defined results: turns go by conv_id and turn (null first), ties by role, then by the hash of role and
text, so repeated rows stand together; a null role or text is one space; rows with a null conv_id
are one conversation; no rows give no conversations; other columns are not looked at. A conversation's
audit is one value, so a task holds some 40 bytes a turn of the conversation it works on, and texts
only batch by batch.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns of one window of the lattice.
WINDOW = 64
#: Rows that one step of a task takes at least, up to the end of a conversation.
_STEP = 8192
#: Costs and the ASCII order of the edits.
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACE = " \t\n\v\f\r"
_OK, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
#: Role state after a kept turn, by state and role (system, user, assistant, other); -1: not allowed.
_KEEP = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
#: Role state after a turn whose role may be chosen, by state.
_NEXT = (2, 2, 3, 2)
_ROLE = (None, None, "user", "assistant")


def _arcs(turn: int, state: int):
    """(letter, cost, state after) of the edits of one turn. turn: 4 times its role plus its fault."""
    role, fault = divmod(turn, 4)
    yield "D", DELETE, state
    if fault in (_OK, _TRUNCATED):
        more = TRUNCATED if fault == _TRUNCATED else 0
        if _KEEP[state][role] >= 0:
            yield "K", more, _KEEP[state][role]
        yield "R", RELABEL + more, _NEXT[state]


#: The arcs of every kind of turn and state.
_ARCS = [[tuple(_arcs(t, s)) for s in range(4)] for t in range(16)]
_LEAST = [min(cost for arcs in _ARCS[t] for _, cost, _ in arcs) for t in range(16)]


def _window(turns: bytes, leave: list | None) -> tuple[list[int], bytes]:
    """(prices of the four entry nodes, best letter of each node). leave: the exact costs from the nodes after
    the last turn; None: the conversation ends here. A letter of zero is no cheapest path, a dot the end."""
    m = len(turns)
    sink = 4 * (m + 1)
    final = leave is None
    leave = [0, None, None, 0] if final else leave
    nodes: list = []
    for k in range(m + 1):
        for s in range(4):
            arcs = [(a, c, 4 * (k + 1) + t) for a, c, t in _ARCS[turns[k]][s]] if k < m else []
            if k < m or final:
                arcs.append(("I", INSERT, 4 * k + _NEXT[s]))
            if k == m and leave[s] is not None:
                arcs.append((".", leave[s], sink))
            nodes.append(arcs)
    bound, price = min(x for x in leave if x is not None), [0] * (sink + 1)
    for k in range(m, -1, -1):                                 # no arc saves more than the bound falls
        bound += _LEAST[turns[k]] if k < m else 0
        price[4 * k:4 * k + 4] = [bound] * 4
    for origin in range(4):
        path = [origin]
        while path[-1] != sink:
            node = path[-1]
            best, to = min([(c + price[t], t) for _, c, t in nodes[node]])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    letters, exact = bytearray(sink + 1), [False] * sink + [True]
    for k in range(m, -1, -1):
        for _ in range(3):                                     # insertions stay on their level
            for node in range(4 * k, 4 * k + 4):
                tight = [a for a, c, t in nodes[node] if exact[t] and price[node] == c + price[t]]
                if tight:
                    exact[node], letters[node] = True, ord(min(tight))
    return price[:4], bytes(letters[:sink if final else 4 * m])


def cheapest_edits(turns: bytes, window: int = WINDOW) -> tuple[int, str]:
    """(cost, letters). turns: a byte a turn, 4 times its role (system, user, assistant, other) plus its fault
    (none, blank, duplicate, truncated)."""
    cuts = list(range(0, max(len(turns), 1), window))
    leave, solved = None, []
    for at in reversed(cuts):
        leave, letters = _window(turns[at:at + window], leave)
        solved.append(letters)
    letters, node, out = b"".join(reversed(solved)), 0, []
    while letters[node] != 46:
        letter = chr(letters[node])
        out.append(letter)
        k, s = divmod(node, 4)
        if letter == "I":
            node = 4 * k + _NEXT[s]
        else:
            node = 4 * (k + 1) + next(t for a, _, t in _ARCS[turns[k]][s] if a == letter)
    return leave[0], "".join(out)


@functools.lru_cache(100_000)
def _remembered(turns: bytes, window: int) -> tuple[int, str]:
    """Short conversations repeat."""
    return cheapest_edits(turns, window)


def _rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    return conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumn(
        "key", F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), 1, 32)))


_ORDER = (F.asc_nulls_first, "turn"), (F.asc, "role"), (F.asc, "key")


def _order() -> list:
    return [f(c) for f, c in _ORDER]


def _starts(column) -> np.ndarray:
    """Where another value begins than in the row before (row 0 begins one)."""
    import pyarrow.compute as pc

    null = column.is_null().to_numpy(zero_copy_only=False)
    value = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
    return np.r_[True, (value[1:] != value[:-1]) | (null[1:] != null[:-1])]


def _whole_conversations(batches):
    """Tables of some thousand rows that end with a conversation. Batches are sorted by column 0."""
    import pyarrow as pa

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _STEP:
            table = pa.Table.from_batches(held).combine_chunks()
            first = np.flatnonzero(_starts(table.column(0).combine_chunks()))
            if first[-1]:
                yield table.slice(0, int(first[-1])).combine_chunks()
                table = table.slice(int(first[-1])).combine_chunks()
            held, rows = table.to_batches(), 0 if len(first) == 1 else table.num_rows
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def audits(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per conversation: conv_id, gaps (turn numbers that lack), blank, duplicate, truncated (turns by their
    first fault), illegal (neighbouring roles), cost and audit (the cheapest edits' initials, in order)."""
    last = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    fault = (F.when(last == "", _BLANK).when(~last.isin(".", "!", "?"), _TRUNCATED).otherwise(_OK)).cast("byte")
    role = F.coalesce(F.element_at(F.create_map(F.lit("s"), F.lit(0), F.lit("u"), F.lit(1), F.lit("a"), F.lit(2)),
                                   F.substring("role", 1, 1)), F.lit(3)).cast("byte")
    rows = _rows(conversations, id_col, turn_col, role_col, text_col).withColumns({"fault": fault, "initial": role}).drop("text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", *_order()).select("conv_id", "turn", "key", "initial", "fault")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for table in _whole_conversations(batches):
            ids, turns = (table.column(i).combine_chunks() for i in (0, 1))
            n = len(ids)
            begins = _starts(ids)
            starts, conv = np.flatnonzero(begins), np.cumsum(begins) - 1
            fault, role = (table.column(i).to_numpy().astype(np.int64) for i in (4, 3))
            key = np.frombuffer(b"".join(table.column(2).to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
            order = np.lexsort((key[:, 1], key[:, 0], conv))   # stable, so the first of equal turns comes first
            again = np.r_[False, (key[order[1:]] == key[order[:-1]]).all(axis=1) & (conv[order[1:]] == conv[order[:-1]])]
            repeated = np.zeros(n, bool)
            repeated[order] = again
            fault[repeated & (fault != _BLANK)] = _DUPLICATE
            given = ~turns.is_null().to_numpy(zero_copy_only=False)
            number = turns.fill_null(0).to_numpy(zero_copy_only=False)
            distinct = given & (begins | _starts(turns))
            high = np.maximum.reduceat(np.where(given, number, np.iinfo(np.int64).min), starts)
            low = np.minimum.reduceat(np.where(given, number, np.iinfo(np.int64).max), starts)
            some = np.add.reduceat(given.astype(np.int64), starts) > 0
            gaps = np.where(some, np.where(some, high, 0) - np.where(some, low, 0) + 1 - np.add.reduceat(distinct.astype(np.int64), starts), 0)
            pair = np.r_[-1, 4 * role[:-1] + role[1:]]          # system-user, user-assistant and assistant-user are legal
            illegal = ~begins & ~np.isin(pair, (1, 6, 9))
            count = lambda x: np.add.reduceat(x.astype(np.int64), starts)
            codes, cuts = (4 * role + fault).astype(np.uint8).tobytes(), np.r_[starts, n].tolist()
            best = [(_remembered if b - a <= 12 else cheapest_edits)(codes[a:b], window) for a, b in zip(cuts, cuts[1:])]
            yield from pa.table([
                ids.take(pa.array(starts)), gaps, *(count(fault == f) for f in (_BLANK, _DUPLICATE, _TRUNCATED)), count(illegal),
                pa.array([c for c, _ in best], pa.int64()), pa.array([a for _, a in best], pa.string())],
                names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]).to_batches()

    return rows.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired(conversations: DataFrame, audited: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """The turns that remain, as ``audited`` (a stored table of ``audits``) says: conv_id, place (from 0), edit, role, text. A
    conversation's turns lie in one partition, in their order."""
    rows = _rows(conversations, id_col, turn_col, role_col, text_col)
    kind = rows.schema["conv_id"].dataType.simpleString()
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    plans = audited.select("conv_id", none("turn"), none("role"), F.col("audit").alias("text"), none("key"), F.lit(0).alias("is_turn"))
    both = plans.union(rows.withColumn("is_turn", F.lit(1))).repartition("conv_id").sortWithinPartitions("conv_id", "is_turn", *_order())

    def run(batches):
        import pyarrow as pa

        conv, plan, at, state, place = None, "", 0, 0, 0
        out: list = []

        def inserted():
            nonlocal at, state
            while at < len(plan) and plan[at] == "I":
                at, state = at + 1, _NEXT[state]
                add("I", _ROLE[state], "")

        def add(edit, role, text):
            nonlocal place
            out.append((conv, place, edit, role, text))
            place += 1

        def hand_on():
            columns = list(zip(*out)) or [[]] * 5
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "place", "edit", "role", "text"])
            out.clear()
            return batch

        types = None
        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
            for c, role, text, is_turn in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3))):
                if not is_turn:
                    conv, plan, at, state, place = c, text, 0, 0, 0
                    inserted()
                    continue
                edit = plan[at]
                at += 1
                if edit == "K":
                    state = _KEEP[state]["sua".find(role[0])]
                    add(edit, role, text)
                elif edit == "R":
                    state = _NEXT[state]
                    add(edit, _ROLE[state], text)
                inserted()
                if len(out) >= _STEP:
                    yield hand_on()
            if out:
                yield hand_on()

    return both.select("conv_id", "role", "text", "is_turn").mapInArrow(
        run, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the ``role:text`` lines of each conversation; turns: as ``repaired`` returns them, in their order."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        import hashlib

        import pyarrow as pa

        conv, sha, done = None, None, []

        def hand_on(kind):
            columns = [pa.array([x[0] for x in done], kind), pa.array([x[1] for x in done], pa.string())]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "sha256"])

        for batch in batches:
            for c, place, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                line = f"{role}:{text}".encode()
                if place:
                    sha.update(b"\n" + line)
                    continue
                if sha is not None:
                    done.append((conv, sha.hexdigest()))
                conv, sha = c, hashlib.sha256(line)
            yield hand_on(batch.schema.field(0).type)
            last = batch.schema.field(0).type
        if sha is not None:
            done.append((conv, sha.hexdigest()))
            yield hand_on(last)

    return turns.mapInArrow(run, f"conv_id {kind}, sha256 string")
