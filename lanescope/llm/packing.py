"""Packing by concatenating and cutting.

All documents' ids, one after another, are one long sequence that is cut into windows of equal
length; only the last window is shorter. Two passes find where a document lies: the first writes the
ids with the running sum inside their partition, sums up each partition and turns the totals into
global offsets by a prefix sum; the second adds the offsets and cuts. No ids are shuffled.

Defined results: a null text counts as empty, a document then is only its end id; every input row is
packed, repeated rows too; the order of documents is that of the input's partitions; an empty
input gives no pieces; other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, slices, small_side, stored
from .pieces import worker_encoder

LENGTH = 2048
#: Pieces that a worker's encoder remembers, fewer than by default: less memory beside the executor's, more pieces encoded again.
REMEMBERED = 400_000


def tokenized(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """First pass, a stored table (id, part, before, n, ids): ids with the end id as little-endian
    unsigned numbers of 2 bytes (4 where the vocabulary needs it), ``before`` counts the ids
    before them in partition ``part``."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(tokenizer_json)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        encoder = worker_encoder(vocabulary.value, limit=REMEMBERED)
        width = id_type(encoder.tokenizer.get_vocab_size(), end_id)
        for batch in slices(batches, 512):
            ids = [np.append(x, end_id) for x in encoder.encode(batch.column(1).to_pylist())]
            n = np.array([len(x) for x in ids], np.int64)
            first = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([part] * len(ids), pa.int64()), pa.array(first), pa.array(n),
                pa.array([x.astype(width).tobytes() for x in ids], pa.binary())], ["id", "part", "before", "n", "ids"])

    path = shared_path(spark, "packing-ids")
    schema = f"id {kind}, part long, before long, n long, ids binary"
    docs.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def id_type(vocabulary_size: int, *others: int) -> str:
    return "<u2" if max(vocabulary_size, *others) < 1 << 16 else "<u4"


def offsets(tokens: DataFrame) -> DataFrame:
    """(part, offset): ids in all partitions before. One row a partition, so the one window is short."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, tokenizer_json: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: id, start (ids of the document before it), length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset (in the sequence)."""
    tokens = tokenized(docs, tokenizer_json, end_id, id_col, text_col)
    kind = tokens.schema["id"].dataType.simpleString()
    placed = (tokens.join(small_side(stored(offsets(tokens), "packing-offsets")), "part")
              .select("id", "n", (F.col("offset") + F.col("before")).alias("at"), "ids"))

    def cut(batches):
        import pyarrow as pa

        for batch in slices(batches, 512):
            n, at = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            first, last = at // length, (at + n - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(seq * length, at[row])
            end = np.minimum((seq + 1) * length, at[row] + n[row])
            start = begin - at[row]
            raw = batch.column(3).to_pylist()
            ids = [np.frombuffer(raw[r], f"<u{len(raw[r]) // n[r]}")[s:s + m].astype("<u4").tobytes()
                   for r, s, m in zip(row.tolist(), start.tolist(), (end - begin).tolist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row)), pa.array(start), pa.array(end - begin), pa.array(ids, pa.binary()),
                pa.array(n[row]), pa.array(seq), pa.array(begin - seq * length)],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(cut, f"id {kind}, start long, length long, ids binary, doc_tokens long, "
                                  "sequence_id long, offset long").withColumnRenamed("id", id_col)


def boundaries(pieces: DataFrame) -> DataFrame:
    """The boundary records: pieces that continue a document of the sequence before."""
    return pieces.filter((F.col("start") > 0) & (F.col("offset") == 0)).drop("ids")
