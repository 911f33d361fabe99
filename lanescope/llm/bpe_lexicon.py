"""BPE encoding and decoding with a lexicon of frequent words.

The words of all documents are counted; the most frequent ones, with the ids that the merges give
them, are compiled into a minimal acyclic transducer (``transducer.py``). Each executor fetches that
file once and its workers map it into memory. Encoding looks words up in it, many at a time, and
merges only unseen words, exactly (``merges.py``). Decoding maps ids back by the vocabulary.

Defined results: a null text encodes as an empty one (no ids, decoded to the empty string); ties of
frequency go to the smaller word; every input row gives one output row, repeated rows too; other
columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import json
from collections import Counter
from itertools import chain

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import publish, slices
from .merges import Merger
from .pieces import PieceEncoder, byte_chars, worker_encoder
from .transducer import Transducer, compile_words

#: Words in the lexicon: a bounded cache of the vocabulary's head; all others are merged exactly.
LEXICON_WORDS = 65_536
#: Pieces that one encoding task remembers.
REMEMBERED = 250_000
#: Distinct words that one task gathers before it hands partial counts on.
_GATHER = 200_000


def word_counts(docs: DataFrame, tokenizer_json: str, text_col: str = "text") -> DataFrame:
    """(word, n): pre-tokens of all texts. Words whose classes depend on the library are left out."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def count(batches):
        import pyarrow as pa

        encoder, words = PieceEncoder(vocabulary.value), Counter()
        pieces_of = encoder._pieces

        def hand_on():
            yield pa.RecordBatch.from_pydict({"word": list(words), "n": list(words.values())},
                                             schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))
            words.clear()

        for batch in slices(batches, 2000):
            texts = [t for t in batch.column(0).to_pylist() if t]
            for piece, n in Counter(chain.from_iterable(map(pieces_of, texts))).items():
                for w in encoder.split(encoder.raw(piece)) or ():
                    if len(w) <= Merger.LONGEST:
                        words[w] += n
            if len(words) >= _GATHER:
                yield from hand_on()
        yield from hand_on()

    return (docs.select(F.col(text_col)).mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def build_lexicon(docs: DataFrame, tokenizer_json: str, text_col: str = "text",
                  size: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the ``size`` most frequent words."""
    top = (word_counts(docs, tokenizer_json, text_col)
           .orderBy(F.desc("n"), "word").limit(size).select("word").toArrow().column(0).to_pylist())
    encoder = PieceEncoder(tokenizer_json)
    ids, n = encoder.encode_words(top)
    cut = np.r_[0, np.cumsum(n)].tolist()
    entries = {w.encode(): tuple(ids[a:b].tolist()) for w, a, b in zip(top, cut, cut[1:])}
    return compile_words(sorted(entries.items()))


def encode(docs: DataFrame, tokenizer_json: str, lexicon: bytes | None = None, id_col: str = "doc_id",
           text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids): ids as binary, little-endian unsigned 32-bit. lexicon: as built, or built here.
    decoded: adds column ``decoded``, the ids decoded again in the same pass."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(tokenizer_json)
    name = publish(spark, "lexicon", build_lexicon(docs, tokenizer_json, text_col) if lexicon is None else lexicon)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType

    def run(batches):
        import pyarrow as pa

        words = Transducer(SparkFiles.get(name))
        encoder = worker_encoder(vocabulary.value, name,
                                 limit=REMEMBERED, lookup=lambda ws: words.lookup([w.encode() for w in ws]))
        text_of = decoder(vocabulary.value) if decoded else None
        for batch in slices(batches, 256):
            ids = encoder.encode(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
            if decoded:
                columns.append(pa.array([text_of(x.tolist()) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][:len(columns)])

    schema = f"id {kind.simpleString()}, ids binary" + ", decoded string" * decoded
    return docs.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decoder(tokenizer_json: str):
    """A function from a list of ids to its text."""
    spec = json.loads(tokenizer_json)
    table = {i: t for t, i in spec["model"]["vocab"].items()}
    added = {t["id"]: t["content"] for t in spec.get("added_tokens", ())}
    table.update(added)
    if spec.get("decoder") is None:                  # no decoder: token strings with spaces between
        token = table.__getitem__
        return lambda ids: " ".join(map(token, ids))
    to_byte = {c: b for b, c in enumerate(byte_chars())}
    raw = {i: t.encode() if i in added else bytes(map(to_byte.__getitem__, t)) for i, t in table.items()}.__getitem__
    return lambda ids: b"".join(map(raw, ids)).decode("utf-8", "replace")


def decode(encoded: DataFrame, tokenizer_json: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded): as the library's decode(ids, skip_special_tokens=False)."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(tokenizer_json)
    encoded = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = encoded.schema["id"].dataType

    def run(batches):
        import pyarrow as pa

        text_of = decoder(vocabulary.value)
        for batch in slices(batches, 256):
            texts = [text_of(np.frombuffer(raw.as_buffer() or b"", "<u4").tolist()) for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    return encoded.mapInArrow(run, f"id {kind.simpleString()}, ids binary, decoded string").withColumnRenamed("id", id_col)
