"""Exact top-k inner products (vector-approximation file).

Vectors are scaled to integers. Equal vectors are stored once with the smallest ids that can be asked for. Each component is
quantised to a cell of one byte; the cells, packed into blocks, are the approximation file. Queries are a table of blocks as
well, and each block of cells meets each block of queries in one row: the scan gives a lower and an upper bound of every score,
and passes on only the pairs that the best lower bounds of their block do not rule out. The kth best lower bound of a query over
all blocks rules out more. The exact vectors of the rest are then read in the order of their upper bounds, a few at first and
four times as many in each round; the kth best score so far falls into place, and a query is done as soon as no bound that is
left reaches it.

Exact scores are sums of whole numbers: of longs where the largest possible sum fits, else of decimals of 38 digits. Bounds are
doubles, widened by more than rounding can add up to.

Defined cases: vectors that are null, empty, hold null or non-finite components, or have another dimension than most (the
smaller one at a tie) take no part; a null id takes no part; every row is a candidate, so repeated rows come as often as they
stand, but no row of the query's own id; a query id with several rows has the k best over all pairs of its rows and the others';
a score that no long can hold is an error; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare, string_columns


@dataclass(frozen=True)
class TopkOptions:
    k: int = 10
    scale: int = 1024
    queries_per_block: int = 512
    vectors_per_block: int = 2048
    cells: int = 256


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v, times): floor(scale * x) of every usable vector, and how many rows have it under this id."""
    rows = string_columns(rows, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(sound).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].d if sizes else 0)).groupBy("vec_id", "v").agg(F.count("*").alias("times"))


def distinct_vectors(vectors: DataFrame, o: TopkOptions) -> DataFrame:
    """(v, ids, vkey) of each distinct vector; `ids` are its k + 1 smallest ids, each with its number of rows.

    More can never be in a result, as one id at most is the query's own. `vkey` is a number of its own for each once written.
    """
    few = vectors.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= o.k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "times"))).alias("ids")).withColumn("vkey", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Grid:
    """The cells' lowest values and widths, by dimension, and the largest size that a bound of a cell can have."""

    low: np.ndarray
    width: np.ndarray
    most: np.ndarray

    @property
    def fits_long(self) -> bool:
        return sum(int(m) ** 2 for m in self.most) < 1 << 63


def cell_grid(distinct: DataFrame, o: TopkOptions) -> Grid:
    spread = distinct.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("d").collect()
    width = [max(1, -(-(r.high - r.low + 1) // o.cells)) for r in spread]
    most = [max(abs(r.low), abs(r.low + w * o.cells)) for r, w in zip(spread, width, strict=True)]
    return Grid(np.array([r.low for r in spread], np.int64), np.array(width, np.uint64), np.array(most, float))


def approximation_file(distinct: DataFrame, grid: Grid, o: TopkOptions) -> DataFrame:
    """(keys, cells): blocks of packed keys and cells, `vectors_per_block` at most in each."""
    low, width = grid.low.view(np.uint64), grid.width

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        cells: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(keys).tobytes()], pa.binary()), pa.array([np.concatenate(cells).tobytes()], pa.binary())], names=["keys", "cells"])

        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            if held and held + batch.num_rows > o.vectors_per_block:
                yield packed()
                keys, cells, held = [], [], 0
            keys.append(np.array(batch.column(0)))
            # Unsigned differences are right for any two longs.
            cells.append(((v.view(np.uint64) - low) // width).astype(np.uint8))
            held += batch.num_rows
        if held:
            yield packed()

    return distinct.select("vkey", "v").mapInArrow(quantise, "keys binary, cells binary")


def query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """(block, names, vectors): the queries (qkey, q), dealt by hash into so many blocks and packed."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names = np.concatenate([np.array(c) for c in table.column("qkey").chunks])
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("q").chunks]).astype(float)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "names": pa.array([names.tobytes()], pa.binary()), "vectors": pa.array([flat.tobytes()], pa.binary())})

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("qkey", F.lit("block")), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(pack, "block long, names binary, vectors binary")


def _scan(cells: DataFrame, asked: DataFrame, blocks: int, grid: Grid, o: TopkOptions) -> DataFrame:
    """(qkey, vkey, low, high): bounds of the vectors that the best bounds of their own block cannot rule out."""
    k = o.k + 1
    base, width, largest = grid.low.astype(float), grid.width.astype(float), grid.most
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    met = cells.withColumn("block", every).join(asked, "block").select("keys", "cells", "names", "vectors")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, raw, names, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vkeys, qkeys = np.frombuffer(keys, np.int64), np.frombuffer(names, np.int64)
                q = np.frombuffer(vectors, float).reshape(len(qkeys), -1)
                least = base + np.frombuffer(raw, np.uint8).reshape(len(vkeys), -1) * width
                most = least + width - 1  # vectors are whole numbers
                up, down = np.maximum(q, 0), np.minimum(q, 0)
                low, high = up @ least.T + down @ most.T, up @ most.T + down @ least.T
                # More than the roundings of both vectors, their products and the sums can come to.
                margin = (np.abs(q) @ largest)[:, None] * (q.shape[1] + 8) * 2.0**-52
                low, high = low - margin, high + margin
                bar = np.partition(low, len(vkeys) - k, axis=1)[:, -k] if len(vkeys) > k else np.full(len(qkeys), -np.inf)
                i, j = np.nonzero(high >= bar[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(qkeys[i]), pa.array(vkeys[j]), pa.array(low[i, j]), pa.array(high[i, j])], names=["qkey", "vkey", "low", "high"])

    return met.mapInArrow(bound, "qkey long, vkey long, low double, high double")


def _exact(pairs: DataFrame, distinct: DataFrame, queries: DataFrame, grid: Grid) -> DataFrame:
    """Read the exact vectors of (qkey, vkey) and form the scores."""
    kind = "long" if grid.fits_long else "decimal(38,0)"
    product = lambda a, b: (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast(kind) if kind != "long" else a * b
    score = F.aggregate(F.zip_with("q", "v", product), F.lit(0).cast(kind), lambda acc, x: (acc + x).cast(kind))
    return pairs.join(distinct.select("vkey", "v"), "vkey").join(queries, "qkey").select("qkey", "vkey", score.alias("score"))


def _certain(near: DataFrame, distinct: DataFrame, queries: DataFrame, grid: Grid, o: TopkOptions, scratch: Scratch) -> DataFrame:
    """(qkey, vkey, score) of each query's best, from bounds (qkey, vkey, high, place), read in the order of their places."""
    k, upto, read = o.k + 1, o.k + 1, None
    left = near
    while True:
        part = scratch.write(_exact(left.where(F.col("place") <= upto), distinct, queries, grid), "scores")
        read = part if read is None else read.unionByName(part)
        best = Window.partitionBy("qkey").orderBy(F.desc("score"), "vkey")
        read = scratch.write(read.select("qkey", "vkey", "score").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"), "best")
        kth = read.groupBy("qkey").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
        # A bound that equals the kth score may still hide a vector of that score with smaller ids.
        left = left.where(F.col("place") > upto).join(kth, "qkey").where("kth IS NULL OR high >= kth").drop("kth")
        left = scratch.write(left, "left")
        if left.isEmpty():
            return read
        upto *= 4


def exact_topk(rows: DataFrame, is_query, options: TopkOptions = TopkOptions()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with `is_query`, its k best of all other rows of (vec_id, embedding)."""
    o, spark = options, prepare(rows.sparkSession)
    scratch = Scratch(spark)
    vectors = scratch.write(integer_vectors(rows, o.scale), "integers")
    schema = "query_id long, rank int, vec_id long, score long"
    distinct = scratch.write(distinct_vectors(vectors, o), "vectors")
    asked = vectors.where(is_query).join(distinct.select("v", F.col("vkey").alias("qkey")), "v").select(F.col("vec_id").alias("query_id"), "times", "qkey")
    asked = scratch.write(asked, "asked")
    queries = distinct.join(asked.select(F.col("qkey").alias("vkey")).distinct(), "vkey").select(F.col("vkey").alias("qkey"), F.col("v").alias("q"))
    queries = scratch.write(queries, "queries")
    blocks = -(-queries.count() // o.queries_per_block)
    if not blocks:
        scratch.clear()
        return spark.createDataFrame([], schema)
    grid = cell_grid(distinct, o)
    cells = scratch.write(approximation_file(distinct, grid, o), "cells")
    near = scratch.write(_scan(cells, scratch.write(query_blocks(queries, blocks), "blocks"), blocks, grid, o), "near")
    # Bounds of all blocks together: the kth best lower bound of a query rules out what lies below it.
    k = o.k + 1
    by_low = Window.partitionBy("qkey").orderBy(F.desc("low"), "vkey")
    bar = near.select("qkey", "low", "vkey").withColumn("r", F.row_number().over(by_low)).where(F.col("r") <= k)
    bar = bar.groupBy("qkey").agg(F.when(F.count("*") == k, F.min("low")).alias("bar"))
    by_high = Window.partitionBy("qkey").orderBy(F.desc("high"), "vkey")
    near = near.join(bar, "qkey").where("bar IS NULL OR high >= bar").withColumn("place", F.row_number().over(by_high))
    near = scratch.write(near.select("qkey", "vkey", "high", "place"), "bounded")
    scores = _certain(near, distinct, queries, grid, o, scratch)
    # A vector's ids follow at its score; k + 1 of them hold the k rows that remain without the query's own.
    ids = scores.join(distinct.select("vkey", "ids"), "vkey").select("qkey", "score", F.inline("ids"))
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    lists = scratch.write(ids.select("qkey", "score", "vec_id", F.col("times").alias("rows")), "lists")
    scratch.clear(asked, lists)
    found = asked.join(lists, "qkey").where("vec_id <> query_id")
    # A row for each pair of a row of the query and a row of the candidate, no more of them than can be in the result.
    found = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least(F.lit(o.k), F.col("times") * F.col("rows")).cast("int"))))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= o.k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
