"""SentencePiece rounds, conversation repair and the prefix trie against the library and brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanescope.llm import auction_repair, piece_merges, prefix_trie, queries
from lanescope.llm.common import binary_file, importable

MODEL = binary_file(queries.PIECE_BPE)
#: columns beside the operators' own that clash with names they use
EXTRA = ", id long, key string, depth int, digest string, kind int, copy int, part int, place int, c int, d int"
CONVERSATIONS = "conv_id long, turn long, role string, text string" + EXTRA
TURNS = ["a.", "b", "é!  ", "x? \n", "", "\x0b ", " ", "c..", "ü b c", None]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "x", 3, 4, 5, 6, 7, 8) for r in rows], CONVERSATIONS)


def some_rows(seed, ids, turns):
    rnd = random.Random(seed)
    rows = [(c, rnd.choice([None, k, k, k + 1]), rnd.choice(["system", "user", "assistant", "tool", None, ""]), rnd.choice(TURNS))
            for c in ids for k in range(rnd.randint(1, turns))]
    rnd.shuffle(rows)
    return rows + rows[:5]                       # repeated rows


def key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


@pytest.fixture()
def folder(spark, tmp_path):
    importable(spark)

    def write(name, df):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write


# -- SentencePiece -------------------------------------------------------------------------

LETTERS = list("aAbBinter  \n\t's'１é ÉǅΣς漢字ñ.,!<s>_‍😀\x00▁﻿\xa0執梦ゼ") + ["  ", "   ", "the", "ing", "    ", "aaaa", "==", "----"]


def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def piece_texts():
    rng = np.random.default_rng(1)
    return ["", " ", "  ", "a" * 3000, " " * 3000 + "x", "ab" * 1500, "=-" * 900, "the " * 10, "\n\n x", "▁", "tie tie"] + [
        "".join(rng.choice(LETTERS, n)) for n in [*rng.integers(1, 60, 1500), 5000]]


def test_pieces_equal_the_library():
    texts, lib = piece_texts(), library()
    coder = piece_merges.PieceCoder(MODEL, limit=2000)
    want = lib.encode(texts, add_bos=True, add_eos=True)
    for _ in range(2):                           # the second time words are remembered or forgotten
        got = coder.encode(texts)
        assert [x.tolist() for x in got] == want
    assert [coder.model.decode(x) for x in got] == lib.decode(want)
    rng = np.random.default_rng(2)
    for _ in range(500):                         # any ids, broken byte runs too
        ids = rng.integers(0, 400, rng.integers(0, 12))
        assert coder.model.decode(ids) == lib.decode(ids.tolist())


def test_rounds_equal_the_heap(monkeypatch):
    texts = piece_texts()
    rounds = piece_merges.PieceCoder(MODEL).encode(texts[:300])
    monkeypatch.setattr(piece_merges, "LONG_SEGMENT", 3)
    heap = piece_merges.PieceCoder(MODEL).encode(texts[:300])
    assert [x.tolist() for x in rounds] == [x.tolist() for x in heap]


def test_piece_query(spark, folder):
    texts = [None, *piece_texts()[:60], "tie tie"]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)] + [(None, "no id", 1, "k")], "doc_id long, text string, id long, ids string")
    path, lib = folder("documents", docs), library()
    got = {r.doc_id: r for r in queries.op12_piece_rounds(spark, path).collect()}
    assert len(got) == len(texts) + 1
    for i, t in [*enumerate(texts), (None, "no id")]:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    coded = piece_merges.encode(docs, MODEL)
    again = {r.doc_id: r.decoded for r in piece_merges.decode(coded, MODEL).collect()}
    assert again[len(texts) - 1] == "tie tie" and again[0] == ""
    assert piece_merges.encode(docs.limit(0), MODEL, decoded=True).count() == 0


# -- repair --------------------------------------------------------------------------------

AFTER_FREE = (2, 2, 3, 2)


def cheapest(rows):
    """(cost, letters, turns) by a forward search over whole letter sequences; rows: (role, text, fault)."""
    def inserted(layer):
        for _ in range(4):
            for q, (c, s, o) in list(layer.items()):
                t = AFTER_FREE[q]
                new = (c + 3, s + "I", (*o, ("user" if t == 2 else "assistant", "")))
                if t not in layer or new[:2] < layer[t][:2]:
                    layer[t] = new
        return layer

    layer = inserted({0: (0, "", ())})
    for role, text, fault in rows:
        new = {}
        for q, (c, s, o) in layer.items():
            ways = [(q, (c + 4, s + "D", o))]
            if fault not in ("b", "d"):
                c += 3 * (fault == "t")
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, role[:1]))
                ways += [(kept, (c, s + "K", (*o, (role, text))))] * (kept is not None)
                ways.append((AFTER_FREE[q], (c + 3, s + "R", (*o, ("user" if AFTER_FREE[q] == 2 else "assistant", text)))))
            for t, way in ways:
                if t not in new or way[:2] < new[t][:2]:
                    new[t] = way
        layer = inserted(new)
    return min(layer[q] for q in (0, 3) if q in layer)


def repaired_by_hand(rows):
    convs, ids = defaultdict(list), set()
    for c, t, r, x in rows:
        ids.add(c)
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        convs[c] += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c in ids:
        turns = sorted(convs[c], key=lambda v: (v[0] is not None, v[0] or 0, v[1], key(*v[1:])))
        given, seen, faulty = [t for t, _, _ in turns if t is not None], set(), []
        for _, r, x in turns:
            end = x.strip(" \t\n\v\f\r")[-1:]
            faulty.append((r, x, "b" if not end else "d" if (r, x) in seen else "t" if end not in ".!?" else ""))
            seen.add((r, x))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, left = cheapest(faulty)
        out.append((c, max(given) - min(given) + 1 - len(set(given)) if given else 0, *(sum(f == k for *_, f in faulty) for k in "bdt"), illegal,
                    cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [1, 3, 64])
def test_cheapest_edits_equal_a_search(window):
    rnd = random.Random(window)
    for n in [*range(9)] * 30 + [40, 150]:
        rows = [(rnd.choice(["system", "user", "assistant", "tool", "user", "assistant"]), "x", rnd.choice(["", "", "", "b", "d", "t"])) for _ in range(n)]
        code = bytes(4 * ("sua".find(r[0]) if r[0] in "sua" else 3) + " bdt".find(f or " ") for r, _, f in rows)
        assert auction_repair.cheapest_edits(code, window) == cheapest(rows)[:2]


def test_a_very_long_conversation_takes_linear_work():
    assert auction_repair.cheapest_edits(bytes([4, 8] * 20_000)) == (0, "K" * 40_000)
    cost, audit = auction_repair.cheapest_edits(bytes([4]) * 4_001)       # user turns alone: half get the other role
    assert (cost, len(audit)) == (3 * 2001, 4002) and audit.count("R") + audit.count("I") == 2001


def test_repair_query(spark, folder, monkeypatch):
    rows = some_rows(2, [*range(250), None, -3], 9) + [(10**9, k, "user", f"t {k % 50}.") for k in range(400)]
    df = conversations(spark, rows).repartition(4)
    monkeypatch.setattr(auction_repair, "_STEP", 64)
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = queries.op11_auction_repair(spark, folder("conversations", df)).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == repaired_by_hand(rows)
    assert auction_repair.audits(df.limit(0)).count() == 0


def test_repaired_turns_alternate(spark):
    df = conversations(spark, some_rows(5, range(40), 8))
    audited = auction_repair.audits(df).cache()
    turns = defaultdict(list)
    for r in auction_repair.repaired(df, audited).collect():
        turns[r.conv_id].append((r.place, r.role))
    for places in turns.values():
        places.sort()
        assert [p for p, _ in places] == list(range(len(places)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, r in places))


# -- trie ----------------------------------------------------------------------------------


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**63, (5000, 2), np.int64).astype(np.uint64), axis=0)
    table = prefix_trie.SlotTable(keys[:4000])
    assert sorted(table.slot.tolist()) == list(range(4000))
    assert (table.find(keys[:4000]) == table.slot).all() and (table.find(keys[4000:]) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.zeros((2, 2), np.uint64))


def trie_by_hand(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", key(r or "", x or ""), x or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[:d - 1]].add(s[:d])
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        n, ends = len(members[p]), sorted(c for c in members[p] if len(whole[c]) == len(p))
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (n - 1) * words + sum(saved[k] for k in children[p])
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, n, len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows():
    rows = some_rows(3, [*range(-30, 90), None, 10**12], 6)
    rows += [(c, t + 10, "user", f"w {t % 3}") for c, n in ((7, 300), (8, 290)) for t in range(n)]
    return rows + [(c, t, "user", f"same {t}") for c in range(5000, 5400, 20) for t in range(3)]


def test_trie_query(spark, folder):
    rows = trie_rows()
    got = queries.op13_prefix_trie(spark, folder("conversations", conversations(spark, rows).repartition(5)))
    assert sorted(map(tuple, got.select(*TRIE).collect()), key=str) == trie_by_hand(rows)


def test_trie_over_many_shards_blocks_and_partitions(spark):
    rows, conf = trie_rows(), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")                # so that one conversation spans partitions
    try:
        df = conversations(spark, rows)
        tables = prefix_trie.prefixes(df, lambda c: c - c % 20, lambda c: F.crc32(c.cast("string").cast("binary")) % 4, 3)
        got = prefix_trie.trie(*tables, shard=6, block=4).select(*TRIE).collect()
        assert sorted(map(tuple, got), key=str) == trie_by_hand(rows)
        parts = prefix_trie._sorted_turns(df, "conv_id", "turn", "role", "text").filter("conv_id = 7").select("part").distinct().count()
        assert parts > 1
    finally:
        spark.conf.unset(conf)


def test_trie_of_nothing_and_of_unshared_conversations(spark):
    df = conversations(spark, [(1, 1, "user", "a b"), (2, 1, "user", "a b"), (2, 2, "user", "c")])
    assert prefix_trie.trie(*prefix_trie.prefixes(df.limit(0))).count() == 0
    got = {tuple(r)[:7] for r in prefix_trie.trie(*prefix_trie.prefixes(df)).select(*TRIE).collect()}
    assert got == {(1, 0, None, 2, 1, 1, 2), (1, 1, 1, 2, 1, 1, 2), (2, 2, 1, 1, 0, 1, 0)}


# -- weak labels ---------------------------------------------------------------------------


def signals_by_hand(text):
    """The labellers' signals in plain Python."""
    import unicodedata

    import regex
    from lanescope.llm import weak_labels
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    n, letters = len(words), [c for c in text if unicodedata.category(c)[0] == "L"]
    plain = regex.compile("[" + weak_labels._PLAIN.replace(r"\s", r" \t\n\x0b\f\r") + "]")
    unspaced = regex.compile(weak_labels._UNSPACED.replace(r"\p{Is", r"\p{")[:-1])
    triples = list(zip(words, words[1:], words[2:]))
    share = lambda a, b: a / b if b > 0 else 0.0
    dense = sum(bool(unspaced.fullmatch(c)) for c in text)
    return {
        "symbols": share(sum(not plain.fullmatch(c) for c in text), len(text)),
        "capitals": share(sum(unicodedata.category(c) == "Lu" for c in text), len(letters)),
        "exclamations": share(text.count("!!"), n), "cells": share(len(re.findall(r"(?:^|\s)\|(?:\s|$)", text)), n),
        "repeated_phrases": share(n - 2 - len(set(triples)), n - 2),
        "repeated_words": share(sum(a == b for a, b in zip(words, words[1:])), n - 1),
        "word_length": share(len(text), n) if dense < 0.3 * len(text) else 11.0}


UNSPACED = ["今天天气很好，我们一起去公园散步吧。孩子们在草地上玩耍，老人们在树下聊天。" * 4, "今日はとても良い天気です。公園へ散歩に行きましょう。「はい」と彼は言った。" * 4,
            "วันนี้อากาศดีมากเราไปเดินเล่นที่สวนสาธารณะกันเถอะเด็กๆกำลังเล่นอยู่บนสนามหญ้า" * 4]


def test_signals_and_votes_equal_plain_python(spark):
    from lanescope.llm import weak_labels
    texts = ["", "  ", "!!! A B C !!!!", "| a | b |  c |", "so so so so it is so", "“Quoted” — text… «oui»", "### $$$ %%%", "ÉCOLE école 12 x́", *UNSPACED,
             "\n".join(["the same line again"] * 9), "w" * 400, "ab 漢 cd ef gh ij kl mn"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect() if r.text]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r for r in weak_labels.with_signals(df, F.col("text"), "s").select("i", "s", weak_labels.votes("s").alias("v")).collect()}
    for i, t in enumerate(texts):
        want = signals_by_hand(t)
        for signal, x in want.items():
            assert got[i].s[signal] == pytest.approx(x), (signal, t[:60])
        assert list(got[i].v) == [-1 if want[s] >= bad else 1 if good is not None and want[s] <= good else 0
                                  for s, bad, good in weak_labels.LABELLERS.values()]
    assert all(-1 not in got[texts.index(t)].v for t in UNSPACED)


def test_posteriors_follow_from_all_votes_and_copies_keep_their_share(spark):
    """Posteriors recomputed from the votes by a plain Python count; a hot text is sampled like any other row."""
    from collections import Counter

    from lanescope.llm import weak_labels
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    hot = docs.filter("text is not null").limit(1).select(F.explode(F.sequence(F.lit(10_000).cast("long"), F.lit(10_099).cast("long"))).alias("doc_id"), "text")
    docs = docs.union(hot)
    rows = weak_labels.with_signals(docs.fillna(""), F.col("text"), "s").select("doc_id", "s.words", weak_labels.votes("s").alias("v")).collect()
    counts = Counter(tuple(r.v) for r in rows if r.words > 0)
    posterior = dict(zip(counts, weak_labels.label_model(list(counts), list(counts.values()))[0].tolist()))
    got = {r.doc_id: r for r in weak_labels.score(docs, columns=["doc_id"], train_rows=150).select("doc_id", "quality.*").collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].posterior == pytest.approx(posterior[tuple(r.v)] if r.words > 0 else 0.0, abs=1e-6)
    assert np.mean([(got[r.doc_id].posterior > 0.5) == got[r.doc_id].keep for r in rows]) > 0.9
