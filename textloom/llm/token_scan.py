"""Token counts of flat, unindexed token files (separator scan).

A flat file is a run of ids of a fixed width (two bytes or four, little-endian) without any index. A folder's files are listed
with their sizes and cut into byte ranges of a fixed number of ids, wherever documents end; each range is a row, and the task that
has it opens the file, reads that range alone and notes in one vectorised comparison where the end-of-document id stands. So a
file may be of any size. A two-level prefix sum over the ranges' small summaries then stitches the documents that cross ranges.

`write_token_files` makes such files from documents, one for each task: the bytes go to the file system itself, and the table that
is returned says which file holds which document as its how-manieth. Only files that a finished task names are read, so what a
lost or repeated task has left behind does no harm.

Defined cases: an empty document has 0 tokens; ids after the last separator are a last document with `ended` false; an empty file
gives no rows; bytes at the end of a file that make no whole id are an error, as is an id that the width cannot hold; a null text
counts as empty; repeated rows count once each; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, materialize, prepare, string_columns
from .tokens import encoder

RANGE_IDS = 1 << 20
CHUNK_BLOCKS = 1024
FLUSH_BYTES = 1 << 22


def _ids(width: int) -> str:
    return {2: "<u2", 4: "<u4"}[width]


def _narrow(ids: bytes, width: int) -> bytes:
    """Ids of four bytes in the file's width."""
    if width == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and int(wide.max()) >= 1 << 16:
        raise ValueError(f"token id {int(wide.max())} does not fit two bytes; write with width=4")
    return wide.astype("<u2").tobytes()


def _file_system(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    head, _, rest = path.partition(":/")
    if not rest or "/" in head:
        return pa_fs.LocalFileSystem(), path
    return pa_fs.FileSystem.from_uri(path if rest.startswith("/") else f"{head}:///{rest}")


def list_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, path, length) of the flat files that a path names; `file_id` is a hash of the file's own path. Nothing is read."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file_id"), "path", "length")


def token_ranges(files: DataFrame, width: int = 2, range_ids: int = RANGE_IDS) -> DataFrame:
    """(file_id, path, length, block_no): a row for each range of a listed file, dealt over the tasks."""
    size = width * range_ids
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}")))
    rows = files.where("length > 0").select("file_id", "path", "length", every.alias("block_no"))
    return rows.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_id", "block_no")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tokenize into flat files, one for each task; the files (file_id, path, length) and their order of documents (file_id, doc_no, doc_id)."""
    spark = prepare(docs.sparkSession)
    folder = folder or f"{checkpoint_dir(spark)}/textloom/flat-{uuid.uuid4().hex}"
    rows = string_columns(docs, "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, words = TaskContext.get(), encoder(tokenizer, literal=True)
        end, number, out, held = _narrow(np.array([end_id], "<u4").tobytes(), width), 0, None, bytearray()
        # An attempt has a file of its own: the rows of the attempt that counts name the file that counts.
        name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.ids"
        fs, own = _file_system(name)
        try:
            for batch in batches:
                for text in batch.column(1):
                    held += _narrow(words.encode(text.as_py()), width) + end
                if out is None and batch.num_rows:
                    fs.create_dir(own.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(own)
                if len(held) >= FLUSH_BYTES:
                    out.write(bytes(held))
                    held.clear()
                numbers = pa.array(np.arange(number, number + batch.num_rows))
                number += batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows, pa.string()), numbers, batch.column(0)], names=["name", "doc_no", "doc_id"])
        finally:
            if out is not None:
                out.write(bytes(held))
                out.close()

    order = materialize(rows.mapInArrow(write, f"name string, doc_no long, doc_id {rows.schema['doc_id'].dataType.simpleString()}"), "order")
    names = order.select("name").distinct()
    if names.isEmpty():
        return spark.createDataFrame([], "file_id long, path string, length long"), order.select(F.lit(0).cast("long").alias("file_id"), "doc_no", "doc_id")
    last = F.element_at(F.split("path", "/"), -1)
    listed = list_token_files(spark, folder).withColumn("last", last).join(names.select("name", F.element_at(F.split("name", "/"), -1).alias("last")), "last")
    listed = materialize(listed.select("file_id", "path", "length", "name"), "files")
    return listed.drop("name"), order.join(listed.select("name", "file_id"), "name").select("file_id", "doc_no", "doc_id")


def scan_separators(files: DataFrame, end_id: int, width: int = 2, range_ids: int = RANGE_IDS) -> DataFrame:
    """One row for each document of the listed flat files (file_id, path, length): file_id, doc_no, start, n_tokens, ended."""
    prepare(files.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for path, length, number in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if length % width:
                    raise ValueError(f"{path} holds {length} bytes: no whole number of ids")
                fs, own = _file_system(path)
                with fs.open_input_file(own) as data:
                    data.seek(number * width * range_ids)
                    ids = np.frombuffer(data.read(width * range_ids), _ids(width))
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file_id", "block_no", "n", "ends"])

    ranges = token_ranges(string_columns(files, "file_id", "path", "length"), width, range_ids)
    blocks = ranges.mapInArrow(scan, "file_id long, block_no long, n long, ends array<long>")
    blocks = materialize(blocks.withColumn("chunk", F.expr(f"block_no div {CHUNK_BLOCKS}")), "separators")
    # First level: sums of chunks of blocks; second level: blocks within their chunk.
    sums = [F.sum("n").alias("n"), F.sum(F.size("ends")).alias("docs"), F.max(F.when(F.size("ends") > 0, F.col("block_no"))).alias("last_block")]
    chunks = blocks.groupBy("file_id", "chunk").agg(*sums, F.max_by(F.expr("element_at(ends, -1)"), F.when(F.size("ends") > 0, F.col("block_no"))).alias("last_at"))
    inside = Window.partitionBy("file_id", "chunk").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("file_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    local = blocks.withColumn("base", zero(F.sum("n").over(inside))).withColumn("docs", zero(F.sum(F.size("ends")).over(inside)))
    local = local.withColumn("prev", F.max(F.when(F.size("ends") > 0, F.col("base") + F.expr("element_at(ends, -1)"))).over(inside))
    firsts = local.groupBy("file_id", "chunk").agg(F.max(F.when(F.size("ends") > 0, F.col("base") + F.expr("element_at(ends, -1)"))).alias("chunk_last"))
    carry = chunks.join(firsts, ["file_id", "chunk"])
    carry = carry.withColumn("chunk_base", zero(F.sum("n").over(across))).withColumn("chunk_docs", zero(F.sum("docs").over(across)))
    carry = carry.withColumn("chunk_prev", F.max(F.col("chunk_base") + F.col("chunk_last")).over(across))
    carry = carry.select("file_id", "chunk", "chunk_base", "chunk_docs", "chunk_prev")
    placed = local.join(carry, ["file_id", "chunk"]).select(
        "file_id",
        (F.col("chunk_base") + F.col("base")).alias("base"),
        (F.col("chunk_docs") + F.col("docs")).alias("docs"),
        F.coalesce(F.col("chunk_base") + F.col("prev"), F.col("chunk_prev"), F.lit(-1)).alias("prev"),
        "n",
        "ends",
    )
    ended = placed.where(F.size("ends") > 0).select("file_id", "base", "docs", "prev", "ends", F.posexplode("ends").alias("i", "at"))
    before = F.when(F.col("i") > 0, F.col("base") + F.expr("element_at(ends, i)")).otherwise(F.col("prev"))
    ended = ended.select("file_id", (F.col("docs") + F.col("i")).alias("doc_no"), (before + 1).alias("start"), (F.col("base") + F.col("at") - before - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    tails = placed.groupBy("file_id").agg(
        F.max(F.col("docs") + F.size("ends")).alias("doc_no"),
        (F.max(F.when(F.size("ends") > 0, F.col("base") + F.expr("element_at(ends, -1)")).otherwise(F.col("prev"))) + 1).alias("start"),
        F.max(F.col("base") + F.col("n")).alias("total"),
    )
    tails = tails.where("total > start").select("file_id", "doc_no", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(tails)


def name_documents(counts: DataFrame, order: DataFrame) -> DataFrame:
    """Give the scanned documents their ids by their place alone: `order` has (file_id, doc_no, doc_id)."""
    return counts.where("ended").join(order, ["file_id", "doc_no"]).select("doc_id", "file_id", "doc_no", "start", "n_tokens")
