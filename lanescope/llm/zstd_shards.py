"""Token ids in zstandard shard files that can be read document by document.

A shard is a row of independent zstandard frames, each with zstandard's own content checksum, then
two skippable frames, so that any zstandard tool can decompress the whole file:

* the document index: for each document its id, a flag for a null id, its number of ids;
* the seek table, at the end of the file: for each data frame its compressed size, decompressed
  size, number of documents and crc32 of the decompressed bytes, then the fixed-size tail
  (``TAIL``): shard number of the writing task, that task's partition, documents, ids, index size,
  frames, id width, format mark and a closing line feed.

Spark's text writer puts each shard into a file of its own (one row a file, the closing line feed is
the writer's line end), so the files go through its commit protocol to any file system; Spark's
binary reader reads them back. Documents are range-partitioned and sorted by id, so that files in
order of (partition, shard) hold the documents in ascending order of id, nulls first.

Defined results: a null text counts as empty, a document then is only its end id; repeated rows and
ids are written each time, in the input's order; an empty input gives no documents; other columns
are not looked at.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, slices, small_side, stored
from .packing import id_type
from .pieces import worker_encoder

#: partition, shard, documents, ids, index bytes, frames, id width, mark (big-endian, for SQL), line feed
TAIL = struct.Struct(">QQQQIIB4sc")
_MARK = b"LSZ1"
_SKIPPABLE = 0x184D2A5E        # zstandard's magic number of a skippable frame
_FRAME = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("docs", "<u4"), ("crc32", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])

FRAME_BYTES = 1 << 18          # a frame is closed beyond so many bytes of ids
SHARD_BYTES = 8 << 20          # a shard is closed beyond so many compressed bytes


class ShardWriter:
    """Builds one shard file in memory (bounded by ``SHARD_BYTES`` and one document)."""

    def __init__(self, width: str, level: int = 1):
        import zstandard

        self.width, self.zstd = width, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.out, self.frames, self.docs, self.open, self.open_docs = io.BytesIO(), [], [], bytearray(), 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.open += ids.astype(self.width).tobytes()
        self.open_docs += 1
        if len(self.open) >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open_docs:
            plain = bytes(self.open)
            packed = self.zstd.compress(plain)
            self.out.write(packed)
            self.frames.append((len(packed), len(plain), self.open_docs, zlib.crc32(plain)))
            self.open, self.open_docs = bytearray(), 0

    def finish(self, partition: int, shard: int) -> bytes:
        """The file without its closing line feed."""
        self.close_frame()
        index = np.array(self.docs, _DOC)
        frames = np.array(self.frames, _FRAME).tobytes()
        tail = TAIL.pack(partition, shard, len(index), int(index["n"].sum()), index.nbytes, len(self.frames),
                         int(self.width[-1]), _MARK, b"\n")
        for body in (index.tobytes(), frames + tail):
            self.out.write(struct.pack("<II", _SKIPPABLE, len(body)))
            self.out.write(body)
        return self.out.getvalue()[:-1]


class ShardReader:
    """Reads documents of one shard; decompresses only the frames that hold them. file: a seekable
    binary file."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, io.SEEK_END)
        file.seek(end - TAIL.size)
        (self.partition, self.shard, docs, self.tokens, index_bytes, frames, width, mark, _) = TAIL.unpack(file.read(TAIL.size))
        if mark != _MARK:
            raise ValueError("not a shard file")
        self.width = f"<u{width}"
        table = end - TAIL.size - frames * _FRAME.itemsize
        file.seek(table - 8 - index_bytes)
        self.index = np.frombuffer(file.read(index_bytes), _DOC)
        file.seek(table)
        self.frames = np.frombuffer(file.read(frames * _FRAME.itemsize), _FRAME)
        if len(self.index) != docs or int(self.index["n"].sum()) != self.tokens:
            raise ValueError("the document index is damaged")
        self.first_doc = np.cumsum(self.frames["docs"], dtype=np.int64) - self.frames["docs"]
        self.first_byte = np.cumsum(self.frames["packed"], dtype=np.int64) - self.frames["packed"]

    def frame(self, k: int) -> np.ndarray:
        """The ids of data frame k, after the check of both checksums."""
        import zstandard

        self.file.seek(int(self.first_byte[k]))
        plain = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.frames["packed"][k])),
                                                        max_output_size=int(self.frames["plain"][k]))
        if zlib.crc32(plain) != self.frames["crc32"][k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(plain, self.width)

    def documents(self, positions: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(position, ids) of the documents at these ascending positions (None: all)."""
        n = self.index["n"].astype(np.int64)
        wanted = range(len(n)) if positions is None else positions
        at, ids, cut = -1, None, None
        for p in wanted:
            k = int(np.searchsorted(self.first_doc, p, "right")) - 1
            if k != at:
                first = int(self.first_doc[k])
                cut = np.r_[0, np.cumsum(n[first:first + int(self.frames["docs"][k])])]
                at, ids = k, self.frame(k)
            i = p - int(self.first_doc[at])
            yield p, ids[cut[i]:cut[i + 1]]


def write_shards(docs: DataFrame, tokenizer_json: str, end_id: int, path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode all documents and write the shard files into folder ``path``."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(tokenizer_json)
    # equal ids may be many: the row's number parts them too
    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
               .withColumn("row", F.monotonically_increasing_id())
               .repartitionByRange("id", "row").sortWithinPartitions("id", "row").select("id", "text"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        encoder = worker_encoder(vocabulary.value)
        width = id_type(encoder.tokenizer.get_vocab_size(), end_id)
        writer = ShardWriter(width)
        row = lambda: pa.RecordBatch.from_pydict({"file": pa.array([writer.finish(part, shard)], pa.binary())})
        for batch in slices(batches, 512):
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                writer.add(doc_id, np.append(ids, end_id))
                if writer.out.tell() >= SHARD_BYTES:
                    yield row()
                    writer, shard = ShardWriter(width), shard + 1
        if writer.docs:
            yield row()

    (ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "none").text(path))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents in the files: start counts the ids of all
    documents before, ids are binary, little-endian unsigned 32-bit."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0)
    number = lambda at, size: F.conv(F.hex(F.expr(
        f"substring(content, int(length) - {TAIL.size - at} + 1, {size})")), 16, 10).cast("long")
    totals = files.select("path", number(0, 8).alias("partition"), number(8, 8).alias("shard"),
                          number(24, 8).alias("tokens"))
    before = Window.orderBy("partition", "shard").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(totals.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first")), "shard-starts")
    placed = files.select("path", "content").join(small_side(first), "path").select("first", "content")

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            shard = ShardReader(io.BytesIO(batch.column(1)[0].as_py()))
            starts = batch.column(0)[0].as_py() + np.cumsum(shard.index["n"].astype(np.int64)) - shard.index["n"].astype(np.int64)
            ids = pa.array(shard.index["id"], mask=shard.index["null"].astype(bool))
            raw = []
            for p, x in shard.documents():
                raw.append(x.astype("<u4").tobytes())
                if len(raw) == 2000 or p + 1 == len(ids):
                    a = p + 1 - len(raw)
                    yield pa.RecordBatch.from_arrays([
                        ids[a:p + 1], pa.array(starts[a:p + 1]), pa.array(shard.index["n"][a:p + 1].astype(np.int64)),
                        pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                    raw = []

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Write all documents into shards in the shared folder, then read them back."""
    path = shared_path(docs.sparkSession, "shards")
    write_shards(docs, tokenizer_json, end_id, path, id_col, text_col)
    return read_shards(docs.sparkSession, path)
