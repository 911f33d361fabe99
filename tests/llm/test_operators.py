"""The operators against brute force and the tokenizers library, on awkward small tables."""

import hashlib
import io
import os
import re
import time
import zlib

import numpy as np
import pytest

from lanescope.llm import (bloom_cascade, bpe_lexicon, cross_entropy, dimension_scan, edits, graph, hnsw, icws, line_dedup, packing,
                           weak_labels, zstd_shards)
from lanescope.llm.common import importable, text_file
from lanescope.llm.pieces import PieceEncoder
from lanescope.llm.queries import BYTE_BPE, URL_RULES, WORD_BPE
from lanescope.llm.transducer import Transducer, compile_words

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORDS = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


ODD = [None, "", "   \n\n  ", "a", "I'm  HERE\n\n 12", "é ÉǅΣςİ 漢字 ́x\x1c\x85y", "x<|endoftext|> y", "b" * 3000, prose(1, 4000),
       "tie tie", "tie tie", "<|startoftext|>", " lead", "trail "]
#: columns beside the operators' own that clash with names they use
SCHEMA = "doc_id long, text string, id long, key string, n int, ids string, bucket int, part int, label string, best string"


@pytest.fixture(scope="module")
def odd(spark):
    importable(spark)
    rows = [(i, t, 1, "k", 2, "z", 3, 4, "l", "b") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (None, "null id", 1, None, None, None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t, lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_pieces_equal_the_library(path):
    _, encode = library(path)
    rng = np.random.default_rng(5)
    letters = list("aB z  \n\t's'll1２é ÉǅΣςİſK\x1c\x85\xa0 ́漢ñ.,!<|endoftext|>_‍😀") + [" I'M ", "<|endoftext|>"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters, n)) for n in rng.integers(1, 40, 800)]
    own = PieceEncoder(text_file(path), limit=300)
    for _ in range(2):                       # the second time most pieces are remembered or forgotten
        assert [x.tolist() for x in own.encode(texts)] == [encode(t) for t in texts]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_pieces_of_letters_need_no_pattern(path):
    _, encode = library(path)
    encoder, asked = PieceEncoder(text_file(path)), []
    words = encoder.words
    encoder.words = lambda piece: asked.append(piece) or words(piece)
    plain = ["The and, with. Été ouÇà, œuvre. élève ªº µm, " + prose(1, 50), "Lone", "End."]
    assert [x.tolist() for x in encoder.encode(plain)] == [encode(t) for t in plain]
    assert set(asked) <= (set() if encoder.lower else {t.split()[0] for t in plain})       # no space before a text's first word
    odd = ["a.b x,, . , .a ,b I'm it's. 1. a1, x-y. ２. 漢, ſ. İ, ǅ. aé, \tq, r.\ns, t.  u, A" + chr(0x301) + ", K, e" + chr(0xad) + ". f" + chr(0x345) + ",", "Été, b.", ","]
    assert [x.tolist() for x in encoder.encode(odd)] == [encode(t) for t in odd]
    for text in odd[0].split():                          # alone, without others that are not plain
        assert PieceEncoder.encode(encoder, [text, text + ","])[1].tolist() == encode(text + ",")


def test_transducer_is_a_map_with_shared_ends():
    entries = sorted({w.encode(): (len(w), 7) for w in ["a", "ab", "abc", "xbc", "talking", "walking", "walked", "é"]}.items())
    fst = Transducer(compile_words(entries))
    assert [tuple(x) for x in fst.lookup([w for w, _ in entries])] == [o for _, o in entries]
    assert fst.lookup([b"", b"abcd", b"w", b"zz"]) == [None] * 4
    assert len(fst.final) < sum(len(w) for w, _ in entries)
    assert Transducer(compile_words([])).lookup([b"a"]) == [None]


def test_bpe_lexicon(odd, empty):
    vocabulary = text_file(WORD_BPE)
    t, encode = library(WORD_BPE)
    texts = {r.doc_id: r.text for r in odd.collect()}
    lexicon = bpe_lexicon.build_lexicon(odd, vocabulary, size=50)
    got = bpe_lexicon.encode(odd, vocabulary, lexicon, decoded=True).collect()
    assert len(got) == odd.count()
    for r in got:
        want = encode(texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == t.decode(want, skip_special_tokens=False)
    again = bpe_lexicon.decode(bpe_lexicon.encode(odd, vocabulary, lexicon), vocabulary).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in again) == sorted((str(r.doc_id), r.decoded) for r in got)
    assert bpe_lexicon.encode(empty, vocabulary, decoded=True).count() == 0


def test_packing(odd, empty):
    _, encode = library(BYTE_BPE)
    want = {}
    for r in odd.collect():
        want.setdefault(r.doc_id, []).append(encode(r.text) + [1])
    pieces = packing.pack(odd, text_file(BYTE_BPE), 1, length=64).collect()
    at = 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert (p.sequence_id, p.offset) == divmod(at, 64) and p.offset + p.length <= 64 and p.length > 0
        assert np.frombuffer(p.ids, "<u4").tolist() == want[p.doc_id][0][p.start:p.start + p.length]
        assert p.doc_tokens == len(want[p.doc_id][0])
        at += p.length
    assert at == sum(len(x) for v in want.values() for x in v)
    assert packing.pack(empty, text_file(BYTE_BPE), 1).count() == 0


def test_zstd_shards(odd, empty):
    _, encode = library(WORD_BPE)
    want = sorted(((r.doc_id, encode(r.text) + [2]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(zstd_shards.round_trip(odd, text_file(WORD_BPE), 2).collect(), key=lambda r: r.start)
    start = 0
    for r, (doc_id, ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert zstd_shards.round_trip(empty, text_file(WORD_BPE), 2).count() == 0


def test_shard_reads_only_wanted_frames_and_finds_damage():
    writer = zstd_shards.ShardWriter("<u2")
    docs = [np.arange(n) % 60000 for n in (0, 5, 200_000, 3, 150_000, 1)]
    for i, d in enumerate(docs):
        writer.add(i, d)
    raw = writer.finish(3, 4) + b"\n"
    shard = zstd_shards.ShardReader(io.BytesIO(raw))
    assert (shard.partition, shard.shard, len(shard.frames)) == (3, 4, 3)
    read = []
    frame, shard.frame = shard.frame, lambda k: read.append(k) or frame(k)
    assert [(p, len(x)) for p, x in shard.documents([4])] == [(4, 150_000)] and read == [1]
    import zstandard
    plain = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw)
    assert plain == np.concatenate(docs).astype("<u2").tobytes()
    broken = bytearray(raw)
    broken[int(shard.first_byte[1]) + 40] ^= 255
    with pytest.raises(Exception):
        zstd_shards.ShardReader(io.BytesIO(bytes(broken))).frame(1)


def bigrams(texts, all_texts):
    """p(v, w) of a model of ``texts`` that shares the words of ``all_texts``, from unhashed counts; v None: before the first word."""
    from collections import Counter

    words, pairs, before = Counter(), Counter(), Counter()
    for t in texts:
        w = (t or "").split()
        words.update(w)
        pairs.update(zip([None, *w], w))
        before.update([None, *w][:-1] if w else [])
    vocabulary = len({w for t in all_texts for w in (t or "").split()}) + 1
    total = words.total()
    return lambda v, w: (pairs[v, w] + 4 * (words[w] + 0.5) / (total + vocabulary / 2)) / (before[v] + 4)


def test_each_contexts_probabilities_sum_to_one():
    texts = [prose(i, 40) for i in range(9)] + ["the cat sat"] * 5 + [None, ""]
    words = sorted({w for t in texts for w in (t or "").split()})
    for some in (texts, texts[:3], [None]):
        p = bigrams(some, texts)
        for v in [None, "never", "the", "sat", *words[:20]]:
            assert sum(p(v, w) for w in words) + p(v, "unseen") == pytest.approx(1, rel=1e-12)


def test_equal_target_and_background_differ_by_nothing(spark):
    importable(spark)
    docs = spark.range(100).selectExpr("id as doc_id", "'the cat sat' as text")
    for n in (10, 100):                                  # the share of the target adds no term of its own
        rows = cross_entropy.score(docs, docs.doc_id < n).collect()
        p = [bigrams(["the cat sat"] * k, ["the cat sat"]) for k in (n, 100)]
        loss = [-np.mean([np.log(m(v, w)) for v, w in ((None, "the"), ("the", "cat"), ("cat", "sat"))]) for m in p]
        for r in rows:
            assert (r.target_loss, r.background_loss) == pytest.approx(loss, rel=1e-9) and min(loss) > 0
    assert all(r.score == 0 for r in rows)


def test_cross_entropy(spark, odd, empty):
    rows = [(i, prose(i, 60) if i % 2 else " ".join(["target", "style", WORDS[i]] * 20)) for i in range(40)]
    docs = spark.createDataFrame([*rows, (100, None), (101, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in cross_entropy.score(docs, docs.doc_id.isin([0, 2, 4, 6])).collect()}
    assert got[100].score is None and got[101].n_tokens == 0
    assert max(got[i].score for i in range(8, 40, 2)) < min(got[i].score for i in range(1, 40, 2))
    models = [bigrams([t for i, t in rows if i in (0, 2, 4, 6)], [t for _, t in rows]), bigrams([t for _, t in rows], [t for _, t in rows])]
    for i, text in rows[:6]:
        losses = [-np.mean([np.log(p(v, w)) for v, w in zip([None, *text.split()], text.split())]) for p in models]
        assert (got[i].target_loss, got[i].background_loss) == pytest.approx(losses, rel=1e-9)
    assert cross_entropy.score(odd, odd.n.isNotNull()).count() == odd.count()
    assert cross_entropy.score(empty, empty.n.isNotNull()).count() == 0


def test_cross_entropy_counts_exactly(spark, monkeypatch):
    """More distinct words and pairs than any table of a fixed size holds apart, against unhashed counts."""
    rng = np.random.default_rng(4)
    texts = [" ".join(["the of", *(f"w{k}" for k in rng.integers(0, 400_000, 9000)), "the of the"]) for _ in range(60)] + ["the of the", "of", "", None]
    texts += texts[:2]
    target = set(range(20))
    importable(spark)
    monkeypatch.setattr(cross_entropy, "HOT", 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in cross_entropy.score(docs, docs.doc_id.isin(sorted(target))).collect()}
    models = [bigrams([texts[i] for i in target], texts), bigrams(texts, texts)]
    for i in (0, 5, 19, 20, 40, 59, 60, 61, 64, 65):
        w = texts[i].split()
        loss = [-np.mean([np.log(p(a, b)) for a, b in zip([None, *w], w)]) for p in models]
        assert (got[i].target_loss, got[i].background_loss, got[i].score) == pytest.approx((*loss, loss[0] - loss[1]), rel=1e-9)
        assert got[i].n_tokens == len(w)
    assert len(got) == len(texts) and all((got[i].n_tokens, got[i].score) == (0, None) for i in (62, 63))
    # words that are too many for a broadcast
    words = spark.createDataFrame([(0, 0, 0, 1, 4), (1, 2, 3, 2, 3), (2, 0, 5, 0, 4)], "word long, t long, b long, ct long, cb long")
    pairs = spark.createDataFrame([(0, 1, 1, 1), (1, 2, 0, 2), (2, 1, 1, 2)], "v long, w long, t long, b long")
    assert sorted(cross_entropy.pair_losses(pairs, words, 0).collect()) == sorted(cross_entropy.pair_losses(pairs, words).collect())


def test_cross_entropy_keeps_no_table_of_pairs(spark, monkeypatch):
    """Few hot and known words, so that every kind of pair occurs; what is written grows with words and texts only."""
    tables = []
    monkeypatch.setattr(cross_entropy, "stored", lambda df, name, keep=cross_entropy.stored: tables.append((name, keep(df, name))) or tables[-1][1])
    for name, value in (("HOT", 6), ("HOT_ROWS", 10), ("KNOWN", 40)):
        monkeypatch.setattr(cross_entropy, name, value, raising=False)
    texts = [("the cat " if i % 3 else "") + prose(i, 150).replace("worda", "the") for i in range(60)] + ["the cat", "cat", "lone", "", None, prose(3, 150)]
    importable(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in cross_entropy.score(docs, docs.doc_id < 15).collect()}
    models = [bigrams(texts[:15], texts), bigrams(texts, texts)]
    for i, text in enumerate(texts):
        w = (text or "").split()
        loss = [-np.mean([np.log(p(a, b)) for a, b in zip([None, *w], w)]) for p in models] if w else [None, None]
        assert got[i].n_tokens == len(w)
        assert (got[i].target_loss, got[i].background_loss) == (pytest.approx(loss, rel=1e-9) if w else (None, None))
    pairs = {p for t in texts for p in zip((t or "").split(), (t or "").split()[1:])}
    assert sum(t.count() for _, t in tables) < len({w for t in texts for w in (t or "").split()}) + 7 * 7 + len(texts) + 2 < len(pairs)


def edit_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


def test_line_dedup(spark, odd, empty):
    base = prose(7, 400)
    near = base.replace(base.split()[200], "changed", 1)
    known = line_dedup.WordHashes()
    hashes = [known.of(list(dict.fromkeys(t.split()))) for t in (base, near)]
    sims = line_dedup.simhashes(np.concatenate(hashes), np.array([len(h) for h in hashes])).tolist()
    assert (sims[0] ^ sims[1]).bit_count() <= 3            # what the pigeonhole blocks guarantee to find
    rows = [(1, f"{base}\n{prose(8, 30)}"), (2, f"unique one\n{base.upper()}!!"), (3, near), (4, prose(9, 30)), (5, "\n\n"), (6, None),
            (7, f"{base}\n{base}"), (8, prose(9, 30) + ".")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.gone) for r in line_dedup.deduplicated(docs, report="gone").collect()}
    assert edit_similarity(base, near) >= 0.8
    assert got == {1: (rows[0][1], []), 2: ("unique one", [1]), 3: ("", [0]), 4: (rows[3][1], []), 5: ("\n\n", []), 6: (None, []),
                   7: ("", [0, 1]), 8: ("", [0])}
    assert line_dedup.deduplicated(odd).columns == odd.columns and line_dedup.deduplicated(odd).count() == odd.count()
    assert line_dedup.deduplicated(empty).count() == 0


def test_line_dedup_finds_similar_lines_of_any_length(spark):
    """Lines of 5 to 60 words with one to a fifth of the words replaced, against all pairs by edit similarity."""
    importable(spark)
    rng = np.random.default_rng(17)
    lines = []
    for i in range(150):
        words = prose(1000 + i, int(rng.integers(5, 61))).split()
        lines.append(" ".join(words))
        for p in rng.choice(len(words), max(1, int(len(words) * rng.uniform(0, 0.2))), False):
            words[p] = f"other{int(rng.integers(100))}"
        lines.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.deduplicated(docs).filter("text = ''").collect()}
    near = docs.alias("x").crossJoin(docs.alias("y")).filter("x.doc_id < y.doc_id").filter(
        "levenshtein(x.text, y.text) <= greatest(length(x.text), length(y.text)) * 0.2 + 1e-9")
    want = {r[0] for r in near.select("y.doc_id").collect()}
    assert len(want) > 120 and got <= want
    assert len(got) >= 0.98 * len(want)
    keys = line_dedup.band_keys(lines)
    assert all((line_dedup.band_keys([lines[i]])[0] == keys[i]).all() for i in range(40))       # of the line alone


def test_line_dedup_compares_few_unlike_lines(spark):
    """Lines of few syllables that share a passage at different places meet in no bucket pair; near copies do."""
    importable(spark)
    rng = np.random.default_rng(23)
    line = lambda n: " ".join("".join(rng.choice(["th", "er", "on", "ing", "ha"], 3)) for _ in range(n))
    passage, lines = line(6), []
    for k in range(120):
        lines.append(f"{passage} {line(60)}" if k % 2 else f"{line(60)} {passage}")
    lines.append(lines[0].replace("ing", "ung", 3))
    docs = spark.createDataFrame([("\n".join(lines[k::4]),) for k in range(4)], "text string")
    rows = line_dedup.shared_bands(docs, len(lines), 0.8)
    pairs = rows.alias("x").join(rows.alias("y"), "bucket").filter("x.id < y.id and abs(x.place - y.place) <= 100")
    found = {tuple(r) for r in pairs.select("x.id", "y.id").distinct().collect()}
    assert 0 < len(found) < 60 * 60                        # the halves with the passage at either end stay apart
    assert line_dedup._bands([lines[0]], 16, 1, 18, 0)[1].max() <= len(lines[0]) - 16
    ranges = line_dedup.class_ranges(0.8)
    for longer in range(1, 400):
        for shorter in range(longer - int(longer * 0.2 + 1e-9), longer + 1):
            assert any(a <= shorter and longer <= b for a, b in ranges)


def test_line_dedup_writes_no_row_for_a_pair_of_unlike_lines(spark, monkeypatch):
    """Lines that share a passage at one place, and near copies beside them, in more than one tile."""
    importable(spark)
    rng = np.random.default_rng(31)
    line = lambda n: " ".join("".join(rng.choice(["th", "er", "on", "ing", "ha", "ou", "st"], 3)) for _ in range(n))
    passage, lines = line(12), []
    lines = [f"{passage} {line(16)}" for _ in range(240)]
    lines += [x.replace("ing", "ung", 2) for x in lines[:60]]
    sizes, plain = {}, line_dedup.stored

    def stored(df, name):
        out = plain(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    for module in (line_dedup, graph):
        monkeypatch.setattr(module, "stored", stored)
    monkeypatch.setattr(line_dedup, "TILE", 64, raising=False)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.deduplicated(docs).filter("text = ''").collect()}
    near = docs.alias("x").crossJoin(docs.alias("y")).filter("x.doc_id < y.doc_id").filter(
        "levenshtein(x.text, y.text) <= greatest(length(x.text), length(y.text)) * 0.2 + 1e-9")
    assert got == {r[0] for r in near.select("y.doc_id").collect()} and len(got) >= 50
    assert sizes["shared-buckets"] > 300 and max(sizes.values()) < 10 * sizes["shared-buckets"]
    assert not any("pairs" in name for name in sizes)


def test_line_dedup_compares_a_pair_in_one_bucket(spark, monkeypatch):
    """Lines that share a long passage meet in several buckets; pairs of about one length are looked up, each once."""
    import pyarrow as pa
    import xxhash

    importable(spark)
    rng = np.random.default_rng(41)
    line = lambda n: " ".join("".join(rng.choice(["th", "er", "on", "ing", "ha", "ou", "st"], 3)) for _ in range(n))
    passage = line(14)
    lines = [f"{line(8)} {passage} {line(int(rng.integers(8, 14)))}" for _ in range(50)]
    lines += [f"{x} {line(1)}" for x in lines[:20]]
    text = {int.from_bytes(xxhash.xxh3_128_digest(x)[:8], "little", signed=True): x for x in lines}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    rows = line_dedup.shared_bands(docs, len(lines), 0.8).toPandas().sort_values(["bucket", "id"])
    seen = rows.assign(tag=(rows.bucket.to_numpy() << line_dedup.PLACE) | rows.place).groupby("id").tag.apply(list)
    ids, zero = rows.id.tolist(), [0] * len(rows)
    table = pa.table([rows.bucket, zero, zero, zero, rows.id, rows.id, rows.length, rows.place, [text[i] for i in ids], seen[ids].tolist()],
                     ["bucket", "i", "j", "side", "id", "comp", "length", "place", "text", "tags"])
    compared, plain, linked, pairs = [], line_dedup.similar_pairs, set(), []
    monkeypatch.setattr(line_dedup, "similar_pairs", lambda lines, a, b, threshold: compared.extend(
        frozenset((lines[i], lines[j])) for i, j in zip(a.tolist(), b.tolist())) or plain(lines, a, b, threshold))
    for bucket in rows.bucket.unique().tolist():
        job = table.filter(pa.array(rows.bucket == bucket))
        length, place, own = (job.column(c).to_numpy().astype(np.int64) for c in ("length", "place", "id"))
        every = np.triu_indices(len(own), 1)
        close = line_dedup._close(*every, length, place, 0.8)
        want = {frozenset((text[a], text[b])) for a, b in zip(own[every[0][close]].tolist(), own[every[1][close]].tolist())}
        got = [frozenset((text[a], text[b])) for x, y in line_dedup._met(job, 0.8) for a, b in zip(own[x].tolist(), own[y].tolist())]
        assert len(got) == len(set(got)) and set(got) == want
        pairs += got
        linked |= {frozenset((text[a], text[b])) for a, b in zip(*line_dedup._links(job, 0.8))}
    assert len(compared) < min(1.25 * len(set(compared)), 0.8 * len(pairs)) and set(compared) == set(pairs)
    assert {frozenset((x, y)) for x, y in zip(lines[:20], lines[50:])} <= linked


def test_normalised_lines_are_words_in_lower_case():
    rng = np.random.default_rng(43)
    texts = ["", "A b\n\tC_9--d\r\n \x1c\x85E", "".join(map(chr, range(128))), "\u00c9t\u00e9 \u4e2d\u6587!\nplain, TEXT", "\u039f\u03a3\nX"]
    texts += ["".join(rng.choice(list("aB \n,._9\t\x1f'\u00df"), 40)) for _ in range(50)]
    for text in texts:
        want = [" ".join(re.findall(r"\w+", line.lower())) for line in text.split("\n")]
        assert line_dedup.normalised(text) == want == [line_dedup.normalise(line) for line in text.split("\n")]
    assert line_dedup.normalised(None) == [""]


def test_line_dedup_keeps_few_files_of_shuffles(spark, monkeypatch):
    """Most of what its shuffles wrote is deleted while it runs; stored tables are compressed well."""
    importable(spark)
    tables, seen, plain = [], set(), line_dedup.stored
    dirs = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {n for d in dirs for _, _, names in os.walk(d) for n in names if n.startswith("shuffle_")}
    before = files()

    def stored(df, name):
        tables.append(plain(df, name))
        seen.update(files() - before)
        return tables[-1]

    monkeypatch.setattr(line_dedup, "stored", stored)
    docs = spark.createDataFrame([(i, f"{prose(i, 30)}\n{prose(i // 2, 40)}") for i in range(60)], "doc_id long, text string")
    line_dedup.duplicate_lines(docs)
    for _ in range(20):
        if len(left := files() & seen) < len(seen) / 2:
            break
        time.sleep(0.5)
    assert len(left) < len(seen) / 2 and len(seen) > 10
    assert all(f.endswith(".zstd.parquet") for t in tables for f in t.inputFiles())


def test_many_pairs_compared_like_single_ones():
    rng = np.random.default_rng(37)
    lines = ["", "a" * 2100, "a" * 1900]
    for k in range(240):
        letters = [list("ab"), list("abcd \u00e9\u6f22"), list("etaoinshrdlu  "), [chr(0x4E00 + i) for i in range(200)] + ["\U0001F600"]][k % 4]
        x = rng.choice(letters, int(rng.integers(0, 320))).tolist()
        lines.append("".join(x))
        for share in (0.1, 0.19, 0.22):
            y = list(x)
            for _ in range(int(len(x) * share)):
                p = int(rng.integers(0, len(y) + 1))
                y[p:p + int(rng.integers(0, 2))] = rng.choice(letters, int(rng.integers(0, 2))).tolist()
            lines.append("".join(y))
    own = np.arange(3, len(lines), 4).repeat(3)
    a = np.r_[own, rng.integers(0, len(lines), 4000), 1]
    b = np.r_[own + np.tile([1, 2, 3], len(own) // 3), rng.integers(0, len(lines), 4000), 2]
    want = [line_dedup.within(lines[i], lines[j], int(max(len(lines[i]), len(lines[j])) * 0.2 + 1e-9)) for i, j in zip(a.tolist(), b.tolist())]
    assert edits.similar_pairs(lines, a, b, 0.8).tolist() == want and 300 < sum(want) < 2000


def test_edits_of_two_lines():
    rng = np.random.default_rng(29)
    for k in range(400):
        letters = list("ab" if k % 2 else "abcd \u00e9\u6f22")
        x = rng.choice(letters, int(rng.integers(0, 150))).tolist()
        y = list(x)
        for _ in range(int(rng.integers(0, 25))):
            p = int(rng.integers(0, len(y) + 1))
            y[p:p + int(rng.integers(0, 2))] = rng.choice(letters, int(rng.integers(0, 2))).tolist()
        x, y = "".join(x), "".join(y)
        edits = round((1 - edit_similarity(x, y)) * max(len(x), len(y), 1))
        assert [line_dedup.within(x, y, m) for m in (edits - 1, edits, edits + 1) if m >= 0] == [False, True, True][edits == 0:]
    base = prose(30, 6000)
    assert line_dedup.within(base, base.replace("worda", "other"), len(base) // 5)
    assert not line_dedup.within(base, prose(31, 6000), len(base) // 5)


def test_icws_groups(spark, odd, empty):
    texts = [prose(20 + i, 120) for i in range(12)]
    for k in range(30):                                   # near copies of text 0, not all alike among themselves
        words = texts[0].split()
        words[(7 * k) % 120] = f"edit{k}"
        texts.append(" ".join(words))
    texts += [texts[0], texts[1], None, "", "one two", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in icws.groups(docs).collect()}
    known, idf = icws.WordHashes(), icws.inverse_frequencies(docs)
    lists = [set((t or "").lower().split()) for t in texts]
    for word in ("edit3", WORDS[0], WORDS[1], "one", "nowhere"):
        n = sum(word in x for x in lists)
        want = min(2, 1 + np.log(len(texts) / n) / np.log(icws.RAREST)) if n else 2
        assert idf.of(known.of([word, word])) == pytest.approx([want, want], rel=1e-6)
    sets = [icws.weighted_set(t, idf, known) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if icws.similarity(sets[i], sets[j]) >= icws.THRESHOLD:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert [got[i].class_id for i in range(len(texts))] == group
    assert [got[i].kept for i in range(len(texts))] == [g == i for i, g in enumerate(group)]
    kept = icws.deduplicated(odd)
    assert kept.columns == odd.columns
    # one row each of the repeated row and of the tie goes
    assert kept.count() == odd.count() - 2
    assert icws.deduplicated(empty).count() == 0


def test_icws_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(3)
    sampler = icws.Sampler(bands=400, rows=1)
    keys = np.sort(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    w = rng.uniform(0.5, 4, 300).astype(np.float32)
    v = (w * rng.choice([1, 0.6], 300)).astype(np.float32)
    a, b = (keys, w), (keys[:250], v[:250])
    agree = (sampler.samples(*a) == sampler.samples(*b)).mean()
    assert agree == pytest.approx(icws.similarity(a, b), abs=0.09)


def vector_rows():
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=16).tolist(), i % 2) for i in range(150)]
    for i in range(40):                                   # near copies and equal ones
        rows.append((200 + i, (np.array(rows[3][1]) + 0.02 * rng.normal(size=16) * (i % 4 > 0)).tolist(), 1))
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] + [1.0] * 15, 1), (304, [1.0] * 3, 1),
             (305, rows[3][1], None), (306, [float("inf")] * 16, 0), (3, rows[3][1], 1)]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    importable(spark)
    return spark.createDataFrame(vector_rows(), "vec_id long, embedding array<double>, label int").selectExpr(
        "*", "1 as id", "2 as n", "'x' as node", "3 as list")


def test_hnsw(vectors):
    rows = vector_rows()
    good = [k for k, (_, v, l) in enumerate(rows) if l is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    comp = {k: rows[k][0] for k in range(len(rows))}
    links = dict.fromkeys(range(len(rows)), 0)
    for a in good:
        for b in good:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if a != b and rows[a][2] == rows[b][2] and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a] += 1
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if c == hi else c for k, c in comp.items()}
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.links(vectors).collect())
    assert got == sorted((rows[k][0], links[k], comp[k], comp[k] == rows[k][0]) for k in range(len(rows)))
    assert hnsw.links(vectors.limit(0)).count() == 0


def test_hnsw_repeated_ids_and_lengths(spark):
    """An id with two vectors joins nothing; vectors of every length link with their like."""
    a, b = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    rows = [(1, a, 1), (1, b, 1), (2, a, 1), (3, b, 1), (6, [1.0, 0.0, 0.05] + [0.0] * 5, 1), (7, [1.0, 2.0], 1), (8, [2.0, 4.0], 1), (9, [1.0, 2.0], 2)]
    importable(spark)
    got = hnsw.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [
        (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (6, 2, 1, False), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True)]


def test_dimension_scan(vectors):
    rows = [r for r in vector_rows() if r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = dimension_scan.search(vectors, vectors.vec_id % 10 == 0, k=5).collect()
    found = total = 0
    for q in sorted({i for i in ids if i % 10 == 0}):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 6))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        score = x @ x[ids == q][0]
        best = sorted(zip(-score[ids != q], ids[ids != q]))[:5]
        for r in own:
            assert r.vec_id != q and any(abs(r.score - s) < 1e-9 for s in score[ids == r.vec_id])
        found += len({r.vec_id for r in own} & {i for _, i in best})
        total += len({i for _, i in best})
    assert found >= 0.9 * total
    assert dimension_scan.search(vectors.limit(0), vectors.vec_id % 10 == 0).count() == 0


def test_dimension_scan_of_every_length_and_of_repeated_ids(spark):
    """Each length is searched in full; an id with several vectors asks with the shortest, then least one."""
    importable(spark)
    rng = np.random.default_rng(23)
    rows = [(i, [float(v) for v in rng.integers(-9, 10, (3, 3, 8)[i % 3])]) for i in range(1, 40)]
    rows = [(i, v) for i, v in rows if any(v)] + [(10, [5.0] * 8), (10, [5.0, 1.0, 0.0]), (10, [4.0, 9.0, 0.0]), (20, [1.0]), (60, [1.0, 2.0]),
                                                  (70, [1e200] * 3), (None, [1.0] * 3), (80, [0.0] * 3), (90, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = dimension_scan.search(table, table.vec_id % 10 == 0, k=4, lists=3, probes=3).collect()
    rows = [(i, v) for i, v in rows if i and v and any(v) and max(v) < 1e100]
    want = []
    for q in sorted({i for i, _ in rows if i % 10 == 0}):
        own = min((v for i, v in rows if i == q), key=lambda v: (len(v), v))
        near = sorted((-float(np.dot(own, v)), i) for i, v in rows if i != q and len(v) == len(own))[:4]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(near, 1)]
    assert sorted(tuple(r) for r in got) == sorted((q, rank, i, pytest.approx(s)) for q, rank, i, s in want)
    assert {r.query_id for r in got} == {10, 30}           # 20 and 60 have no vector of their length beside them


def test_bloom_cascade(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/1?x", "https://example.org/es/y#z", "http://notexample.org/es/", "http://org/",
            "http://org", "ftp://x.com/de/", "http://x.com/fr/a", "http://com.x/de/", "http://a.b.c.net/", "http://x.com/d", "x://y://z.org/",
            "http://" + "a." * 500 + "org/" + "p" * 5000] + [f"http://h{i}.org/p{i}" for i in range(300)]
    pages = spark.createDataFrame([*enumerate(urls), (None, urls[5]), (4, urls[4])], "page_id long, url string").selectExpr("*", "1 as host", "2 as id")
    importable(spark)
    got = sorted(map(str, bloom_cascade.judge(pages, URL_RULES).collect()))
    want = []
    for r in pages.collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        want.append(f"Row(page_id={r.page_id}, host={host!r}, path={path!r}, rule={rule!r}, verdict={verdict!r})")
    assert got == sorted(want)
    assert bloom_cascade.judge(pages.limit(0), URL_RULES).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    importable(spark)
    universe = spark.range(3000).selectExpr("cast(id as string) as key")
    listed = universe.filter("cast(key as int) % 7 = 0")
    cascade = bloom_cascade.build(universe, listed)
    assert len(cascade.levels) > 1
    hashed = universe.select("key", *[h for k in range(len(cascade.levels)) for h in bloom_cascade._hashes(universe.key, k)]).toPandas()
    hits = cascade.test([(hashed.iloc[:, 1 + 2 * k].to_numpy(), hashed.iloc[:, 2 + 2 * k].to_numpy()) for k in range(len(cascade.levels))])
    assert [int(k) % 7 == 0 for k in hashed["key"]] == hits.tolist()


def test_weak_labels(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = weak_labels.score(docs).join(labels.select("doc_id", labels.quality.alias("truth")), "doc_id").select("truth", "quality.keep").collect()
    assert np.mean([r.keep == bool(r.truth) for r in got]) >= 0.93
    good = [r.keep for r in got if r.truth]
    assert np.mean(good) >= 0.97
    marked = weak_labels.score(odd, name="verdict_here")
    assert marked.columns == [*odd.columns, "verdict_here"] and marked.count() == odd.count()
    assert not any(r.verdict_here.keep for r in marked.filter("text is null or trim(text) = ''").collect())
    assert weak_labels.score(empty).count() == 0


def test_label_model_finds_the_better_labeller():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.8
    patterns = [tuple(np.where(rng.random(3) < [0.95, 0.9, 0.6], t, not t) * 2 - 1) for t in truth]
    kinds = sorted(set(patterns))
    posterior, _ = weak_labels.label_model(kinds, [patterns.count(k) for k in kinds])
    table = dict(zip(kinds, posterior))
    assert np.mean([(table[p] > 0.5) == t for p, t in zip(patterns, truth)]) > 0.9


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    importable(spark)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        then, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert now.columns == then.columns and 0 < now.count() <= then.count()
    assert {r.doc_id for r in now.collect()} == {r.doc_id for r in then.collect()}
    assert hashlib.sha256(str(sorted(map(str, now.collect()))).encode()).hexdigest()


def test_copies_without_words_are_reduced_to_one(spark):
    import corpus_pipeline

    texts = ["*** ---", "", "*** ---", None, "", "***", prose(50, 30), prose(50, 30).upper(), "\n" + prose(50, 30) + "\n ", None]
    importable(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.kept) for r in icws.groups(docs).collect()}
    assert got == {0: (0, True), 1: (1, True), 2: (0, False), 3: (3, True), 4: (1, False), 5: (5, True), 6: (6, True), 7: (6, False), 8: (6, False),
                   9: (9, True)}
    assert {r.doc_id for r in icws.deduplicated(docs).collect()} == {0, 1, 3, 5, 6, 9}
    # documents that line dedup empties do not go on; those without words from the start do
    assert {r.doc_id for r in corpus_pipeline.drop_lines(spark, docs, "").collect()} == {0, 1, 2, 3, 4, 5, 6, 9}
