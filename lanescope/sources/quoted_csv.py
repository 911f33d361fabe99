"""CSV files with line breaks inside quoted fields, read by byte ranges.

Spark's ``multiLine`` reader gives a whole file to one task, because a range cannot know whether it
begins inside quotes. Here the files are read as lines, in the ranges that Spark cuts, and written once to
the shared folder with what a range can know by itself: each line's place and whether the quotes before it
in that range are odd. A prefix XOR over the ranges of a file (one row a range) tells which ranges begin
inside quotes. A line that neither begins nor ends inside quotes is a record. The others, few in most
files, get the number of their record by prefix sums (inside a range, then over ranges) and are glued together, so a
record may span ranges, and one huge file is read by many tasks.

Quotes are those of RFC 4180: only in quoted fields, doubled inside them. Lines end with a line feed; a carriage
return before it belongs to the line end, unless it is inside quotes, where line breaks stay as they are. Blank records are skipped, as Spark's readers do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def line_table(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """(file, start, seq, before, after, line), written to ``folder``: seq counts the lines of the range that begins at
    ``start``; before and after are the parity of the range's quotes up to the line, without and with it."""
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        here, seq, parity = None, 0, 0
        for batch in batches:
            file, start = (batch.column(i).to_numpy() for i in (0, 1))
            odd = pc.count_substring(batch.column(2), '"').to_numpy() & 1
            cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(file)]):
                if a == b:
                    continue
                if here != (file[a], start[a]):
                    here, seq, parity = (file[a], start[a]), 0, 0
                after = (parity + np.cumsum(odd[a:b])) & 1
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(np.arange(seq, seq + b - a)), pa.array((after ^ odd[a:b]).astype(np.int32)),
                    pa.array(after.astype(np.int32)), part.column(2)], ["file", "start", "seq", "before", "after", "line"])
                seq, parity = seq + b - a, int(after[-1])

    schema = "file long, start long, seq long, before int, after int, line string"
    lines.mapInArrow(run, schema).write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def records(lines: DataFrame) -> DataFrame:
    """(file, start, seq, record) from a ``line_table``; start and seq are those of the record's first line."""
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # odd ranges only: the others change nothing, and plain files have none
    ranges = lines.groupBy("file", "start").agg(F.bit_xor(F.col("before").bitwiseXOR(F.col("after"))).alias("odd"))
    inside = ranges.select("file", "start", F.coalesce(F.bit_xor("odd").over(earlier), F.lit(0)).alias("inside")).where("inside = 1")
    known = lines.join(inside, ["file", "start"], "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    known = known.select("file", "start", "seq", F.col("before").bitwiseXOR(F.col("inside")).alias("before"),
                         F.col("after").bitwiseXOR(F.col("inside")).alias("after"), "line")
    single = known.where("before = 0 AND after = 0").select("file", "start", "seq", F.col("line").alias("record"))
    parts = known.where("before = 1 OR after = 1").withColumn("first", 1 - F.col("before"))
    upto = Window.partitionBy("file", "start").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("local", F.sum("first").over(upto))
    begun = parts.groupBy("file", "start").agg(F.sum("first").alias("n"))
    begun = begun.select("file", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    glued = (parts.join(begun, ["file", "start"])
             .groupBy("file", (F.col("base") + F.col("local")).alias("number"))
             .agg(F.array_sort(F.collect_list(F.struct("start", "seq", "line"))).alias("lines")))
    return single.union(glued.select("file", F.col("lines")[0]["start"], F.col("lines")[0]["seq"],
                                     F.array_join(F.transform("lines", lambda x: x["line"]), "\n")))


def parsed(found: DataFrame, columns: list[str], malformed: str, options: dict[str, str], strict: bool = False) -> DataFrame:
    """The text columns of ``records`` after the files' headers, and in ``malformed`` the record whose number of fields is wrong."""
    record = F.regexp_replace("record", "\r$", "")
    is_header = (F.col("start") == 0) & (F.col("seq") == 0)
    title = F.regexp_replace(F.regexp_replace(record, "^﻿", ""), '"', "")
    wrong = F.raise_error(F.concat(F.lit("the header does not name the expected columns: "), title)).cast("boolean")
    found = found.where(F.when(is_header, F.when(title == ",".join(columns), F.lit(False)).otherwise(wrong)).otherwise(record != ""))
    schema = ", ".join(f"`{c}` string" for c in [*columns, malformed])
    row = F.from_csv(record, schema, {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": malformed})
    out = found.select(row.alias("row")).select(*[F.col("row")[c].alias(c) for c in [*columns, malformed]])
    return stop_at(out, malformed) if strict else out


def stop_at(rows: DataFrame, malformed: str) -> DataFrame:
    """``rows`` without the column ``malformed``; a row that has it stops the job."""
    bad: Column = F.raise_error(F.concat(F.lit("malformed record: "), F.col(malformed))).cast("boolean")
    return rows.where(F.when(F.col(malformed).isNull(), F.lit(True)).otherwise(bad)).drop(malformed)
