"""Token counts from flat, unindexed token files: a vectorised scan for the end-of-document id.

A token file is a plain run of big-endian 16-bit ids, each document closed by ``EOD``; nothing says where
documents begin. Spark splits files of any size; its line reader, told to end lines at a byte that cannot part a separator, gives
each split the bytes behind the first such byte. What a split reads is cut into blocks, each searched on its own with numpy for the
separator's two bytes at even and odd places. A prefix scan over the blocks of a file then gives each block the place of
its first byte, so which parity is the true one, and the last separator and the number of separators before it, which
stitches documents that cross blocks.

An empty file has no documents. Ids behind the last separator are a document without an end, reported with ``closed`` false; a
single byte behind the last whole id is left out. Consecutive separators are empty documents. Files are known by their
whole path. An empty table is written as files without documents; other columns of the table are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm import bpe
from attestra.llm.common import broadcast_if_small, map_rows, materialize, shared_path, table

EOD = 50256
#: Bytes in a block, or a little more.
BLOCK_BYTES = 1 << 20
#: Documents in a file at most, so that files are of a size that any reader takes.
FILE_DOCS = 20_000


def write_token_files(
    docs: DataFrame, path: str, text_col: str = "text", vocabulary_path: str | None = None, pattern: str | None = None,
    eod: int = EOD,
) -> None:
    """Encode whole texts (null: empty) and write them as flat files below ``path``, through Spark's own writer.

    The text writer emits a row's bytes as they are and then its line separator; the row carries all but
    the last byte of the closing separator id and the line separator is that last byte.
    """
    low = chr(eod & 0xFF)
    if eod & 0xFF > 0x7F or eod > 0xFFFF:
        raise ValueError("the separator id needs 16 bits and a low byte below 128")
    default_path, default_pattern = bpe.default_vocabulary()
    pattern = pattern or default_pattern
    shared = docs.sparkSession.sparkContext.broadcast(bpe.vocabulary_bytes(vocabulary_path or default_path))
    high = bytes([eod >> 8])

    def per_batch(texts):
        encoder = bpe._encoder(shared.value, pattern, "u16")
        return [[packed + high for packed in encoder.many([t or "" for t in texts])]]

    ids = map_rows(docs.select(text_col), per_batch, "ids binary", holds="bpe")
    (
        ids.select(F.col("ids").cast("string").alias("value"))
        .write.option("lineSep", low).option("maxRecordsPerFile", FILE_DOCS).text(path)
    )


def line_byte(eod: int) -> int:
    """A byte below 128 behind which no separator can be parted: not its first byte, its last one where that will do."""
    return eod & 0xFF if eod & 0xFF < 0x80 and eod & 0xFF != eod >> 8 else next(b for b in (0, 1) if b != eod >> 8)


def scan_blocks(spark: SparkSession, path: str, eod: int = EOD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks as (file, split, block, size, places, file_size): ``places`` are those of the separator's bytes in the block."""
    line = bytes([line_byte(eod)])
    rows = spark.read.option("lineSep", line.decode("ascii")).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("file_size"),
        F.col("value").cast("binary").alias("bytes"),
    )

    def search(batches):
        at, number, held, size = None, 0, [], 0
        out: list[tuple] = []

        def block():
            data = np.frombuffer(line.join([*held, b""]), np.uint8)
            places = np.flatnonzero((data[:-1] == eod >> 8) & (data[1:] == eod & 0xFF)) if len(data) > 1 else []
            out.append((at[0], at[1], number, len(data), list(map(int, places)), at[2]))

        def batch_of():
            columns = list(zip(*out, strict=True))
            out.clear()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "split", "block", "size", "places", "file_size"])

        for batch in batches:
            for file, split, file_size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or (file, split) != at[:2]:
                    if held:
                        block()
                    at, number, held, size = (file, split, file_size), 0, [], 0
                held.append(data)
                size += len(data) + 1
                if size >= block_bytes:
                    block()
                    number, held, size = number + 1, [], 0
            if out:
                yield batch_of()
        if held:
            block()
        if out:
            yield batch_of()

    return rows.mapInArrow(search, "file string, split long, block long, size long, places array<long>, file_size long")


def scan_token_files(spark: SparkSession, path: str, eod: int = EOD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: file, its number in the file, first id, number of ids, and whether it is closed.

    Blocks are written once; only their summaries, a row of numbers each, meet by file for the prefix scan.
    """
    blocks = materialize(scan_blocks(spark, path, eod, block_bytes), "blocks")
    key = ["file", "split", "block"]
    order = Window.partitionBy("file").orderBy("split", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # The reader ends a file's last line even where its byte is missing, so places are held against the file's size.
    sized = blocks.select(*key, "size", "file_size", *[
        F.expr(f"filter(places, p -> p % 2 = {q})").alias(f"p{q}") for q in (0, 1)
    ]).select(*key, "size", "file_size", *[F.size(f"p{q}").alias(f"n{q}") for q in (0, 1)], *[F.try_element_at(f"p{q}", F.lit(-1)).alias(f"last{q}") for q in (0, 1)])
    begun = sized.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("even", F.col("start") % 2 == 0)
    begun = begun.withColumn("last", F.col("start") + F.when(F.col("even"), F.col("last0")).otherwise(F.col("last1"))).withColumn(
        "n", F.when(F.col("even"), F.col("n0")).otherwise(F.col("n1")))
    past = F.col("last") + 2 > F.col("file_size")
    begun = begun.withColumn("n", F.when(past, F.col("n") - 1).otherwise(F.col("n")))
    # A place past the end can only be the last of the file, behind which nothing is carried.
    scanned = begun.select(
        *key, "start", "file_size",
        F.coalesce(F.max("last").over(before), F.lit(-2)).alias("carried"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seen"),
        F.lead("block").over(order).isNull().alias("final"),
    )
    places = F.filter(F.transform("places", lambda p: F.col("start") + p), lambda p: (p % 2 == 0) & (p + 2 <= F.col("file_size")))
    placed = blocks.drop("file_size", "size").join(broadcast_if_small(scanned, "file"), key).withColumn("ends", places)
    ended = placed.select("file", "seen", "carried", "ends", "final", F.expr("file_size div 2").alias("ids"))
    closed = ended.select("file", F.explode(F.expr("""
        transform(ends, (e, i) -> struct(
            seen + i as doc, (if(i = 0, carried, ends[i - 1]) + 2) div 2 as first_id,
            (e - if(i = 0, carried, ends[i - 1]) - 2) div 2 as n_tokens, true as closed))""")).alias("d"))
    last = F.expr("(coalesce(try_element_at(ends, -1), carried) + 2) div 2")
    still_open = ended.where(F.col("final") & (F.col("ids") > last)).select("file", F.struct(
        (F.col("seen") + F.size("ends")).alias("doc"), last.alias("first_id"), (F.col("ids") - last).alias("n_tokens"), F.lit(False).alias("closed"),
    ).alias("d"))
    return closed.unionByName(still_open).select("file", "d.doc", "d.first_id", "d.n_tokens", "d.closed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    found = scan_token_files(spark, path)
    return found.select(
        F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("int").alias("file_no"),
        F.regexp_extract("file", r"-c(\d+)[^/]*$", 1).cast("int").alias("file_part"),
        "doc", "first_id", "n_tokens", "closed",
    )
