"""Substring search through a posting table of trigrams.

Each row's search text, in lower case, is cut once into its distinct runs of three characters. The tasks that read the texts gather
the ids of each run in lists, and these lists, not a row for each id, are dealt into folders by hash and ordered in them. A query
reads the lists of its rarest few runs alone, the rows that have all of them are looked up, and the exact test decides. Queries of
fewer than three characters are tested against all rows.

Defined cases: a null search text is found by nothing but the blank query, which finds every row; ids must not be null; an id that
is given again counts once; rows that are added later bring lists of their own (`add_to_index`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_batches, spread

GRAM, FOLDERS, RAREST = 3, 64, 3
#: Ids that a task gathers before it gives out their lists, and characters of a text that are cut at once.
GATHERED, PART = 2_000_000, 1_000_000


def grams(text: Column) -> Column:
    """Distinct runs of three characters; one pass, as the text is split into characters once."""
    letters = F.split(F.lower(text), "")
    both = lambda a, b: F.concat(a, b)
    runs = F.zip_with(F.zip_with(letters, F.slice(letters, 2, F.size(letters)), both), F.slice(letters, 3, F.size(letters)), both)
    return F.array_distinct(F.array_compact(runs))


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    path: str
    id: str
    text: str


def _first(ordered: np.ndarray) -> np.ndarray:
    """Where ordered numbers differ from the one before."""
    return np.concatenate([[True], ordered[1:] != ordered[:-1]])


def _runs(text: str) -> np.ndarray:
    """Distinct runs of three characters, ordered, as numbers of 21 bits for each character."""
    found = []
    for start in range(0, len(text) - GRAM + 1, PART):
        letters = np.frombuffer(text[start : start + PART + GRAM - 1].encode("utf-32-le"), np.uint32).astype(np.int64)
        runs = letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:]
        runs.sort()
        found.append(runs[_first(runs)])
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _lists(ids: pa.Array, counts: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
    """Each run with the ids of the texts that hold it; counts: the runs of each text, which stand text after text."""
    order = np.argsort(runs, kind="stable")
    runs, places = runs[order], np.repeat(np.arange(len(counts)), counts)[order]
    starts = np.flatnonzero(_first(runs))
    letters = np.stack([runs[starts] >> shift & 0x1FFFFF for shift in (42, 21, 0)], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
    grams = pa.array([letters[i : i + GRAM] for i in range(0, len(letters), GRAM)], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(runs)), pa.int32()), ids.take(pa.array(places)))
    return pa.RecordBatch.from_arrays([grams, lists], names=["gram", "ids"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, counts, runs, held = [], [], [], 0

    def lists() -> pa.RecordBatch:
        return _lists(pa.concat_arrays(ids), np.concatenate(counts), np.concatenate(runs))

    for batch in batches:
        if not batch.num_rows:
            continue
        found = [_runs(text.as_py()) for text in batch["text"]]
        ids.append(batch["id"].take(pa.array(range(batch.num_rows))))  # a copy: the column itself would keep the texts of its batch
        counts.append(np.array([len(x) for x in found]))
        runs.append(np.concatenate(found))
        held += len(runs[-1])
        if held >= GATHERED:
            yield lists()
            ids, counts, runs, held = [], [], [], 0
    if runs:
        yield lists()


def _schema(rows: DataFrame, index: SearchIndex) -> T.StructType:
    return T.StructType().add("gram", "string").add("ids", T.ArrayType(rows.select(index.id).schema[0].dataType))


def add_to_index(rows: DataFrame, index: SearchIndex) -> None:
    """Write the postings of rows that are not indexed yet."""
    small_batches(rows.sparkSession)
    texts = spread(rows.select(F.col(index.id).alias("id"), F.lower(F.col(index.text)).alias("text"))).where(F.length("text") >= GRAM)
    posted = texts.mapInArrow(_gathered, _schema(rows, index)).withColumn("folder", _folder(F.col("gram")))
    # Each folder's rows in few files, ordered, so that a file's statistics tell which of its parts hold a gram.
    posted.repartition("folder", F.pmod(F.xxhash64("gram", F.lit(1)), F.lit(4))).sortWithinPartitions("folder", "gram").write.mode("append").partitionBy("folder").parquet(f"{index.path}/postings")


def build_index(rows: DataFrame, id: str, text: str, path: str) -> SearchIndex:
    index = SearchIndex(path, id, text)
    add_to_index(rows, index)
    return index


def candidates(rows: DataFrame, index: SearchIndex, query: str) -> DataFrame:
    """(id) of the rows that hold the rarest trigrams of a query."""
    spark = rows.sparkSession
    wanted = [r.g for r in spark.range(1).select(F.explode(grams(F.lit(query))).alias("g")).collect() if len(r.g) == GRAM]
    # With its schema, as an index of texts that are all too short has no file to tell it.
    postings = spark.read.schema(_schema(rows, index).add("folder", T.IntegerType())).parquet(f"{index.path}/postings")
    folders = [r.f for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(_folder(F.col("g")).alias("f")).distinct().collect()]
    found = postings.where(F.col("folder").isin(folders) & F.col("gram").isin(wanted))
    counts = {r.gram: r.n for r in found.groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).collect()}  # a row for each trigram of the query
    rarest = sorted(wanted, key=lambda g: (counts.get(g, 0), g))[:RAREST]
    every = reduce(Column.__and__, [F.max(F.col("gram") == g) for g in rarest])
    return found.where(F.col("gram").isin(rarest)).select("gram", F.explode("ids").alias("id")).groupBy("id").agg(every.alias("every")).where("every").select("id")


def indexed_search(rows: DataFrame, index: SearchIndex, query: str) -> DataFrame:
    """The rows whose search text contains the query, in any case and without blanks around it."""
    wanted = query.strip().lower()
    if not wanted:
        return rows
    if len(wanted) >= GRAM:
        rows = rows.join(candidates(rows, index, wanted).withColumnRenamed("id", index.id), index.id, "left_semi")
    return rows.where(F.contains(F.lower(F.col(index.text)), F.lit(wanted)))
