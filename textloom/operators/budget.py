"""Word-budget chunks of files that are many rows: where each chunk begins, without a walk through the file.

A chunk takes segments in order while its words stay within the budget; a longer segment is a chunk of its own. Where the chunk
that begins at a segment ends depends on prefix sums alone, so each segment learns where the next chunk would begin if one began
here. The chunks that do begin are what the first segment reaches: by pointer doubling, steps of 1, 2, 4, ... chunks, each round
twice as far. No file meets in one task: prefix sums have two levels, and the search for a chunk's end meets in buckets of words.

Defined cases: segments of no words join the chunk before them; a null number of words counts as none; files without segments
give no rows; `seg_no` need not be dense, but must be unique in a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Tables

ROWS_PER_BLOCK = 4096


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A join that sorts both sides. These tables of numbers take so few bytes in files that they would be broadcast, many millions
    of rows through the driver."""
    return left.join(right.hint("merge"), on)


def placed(rows: DataFrame) -> DataFrame:
    """(file_id, seg_no, at, upto): the words before each segment, and with it; sums of blocks first, then within them."""
    rows = rows.select("file_id", "seg_no", F.greatest(F.coalesce(F.col("words"), F.lit(0)), F.lit(0)).cast("long").alias("words"), F.expr(f"seg_no div {ROWS_PER_BLOCK}").alias("block"))
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("file_id", "block").agg(F.sum("words").alias("w")).select("file_id", "block", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file_id", "block").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0)
    upto = _met(rows.withColumn("upto", F.sum("words").over(inside)), base, ["file_id", "block"])
    return upto.select("file_id", "seg_no", (F.col("base") + F.col("upto") - F.col("words")).alias("at"), (F.col("base") + F.col("upto")).alias("upto"))


def next_chunks(sums: DataFrame, max_words: int) -> DataFrame:
    """(file_id, seg_no, last): the last segment of the chunk that would begin at each segment.

    It is the last one whose words end within the budget. Those end in the bucket of the budget's end or in the one before, so
    that each segment shows itself in two buckets and asks in one.
    """
    size = max_words + 1
    shown = sums.select("file_id", F.col("upto").alias("place"), F.col("seg_no").alias("shown"), F.lit(None).cast("long").alias("asks"), F.explode(F.array(F.expr(f"upto div {size}"), F.expr(f"upto div {size} + 1"))).alias("bucket"))
    end = F.col("at") + max_words
    asked = sums.select("file_id", end.alias("place"), F.lit(None).cast("long").alias("shown"), F.col("seg_no").alias("asks"), F.floor(end / F.lit(size)).alias("bucket"))
    seen = Window.partitionBy("file_id", "bucket").orderBy("place", F.col("asks").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = shown.withColumn("shown", F.col("shown").cast("long")).unionByName(asked.withColumn("asks", F.col("asks").cast("long")))
    found = met.withColumn("last", F.max("shown").over(seen)).where("asks IS NOT NULL")
    return found.select("file_id", F.col("asks").alias("seg_no"), F.greatest(F.col("last"), F.col("asks")).alias("last"))


def budget_chunks(rows: DataFrame, max_words: int = 500) -> DataFrame:
    """(file_id, chunk_no, first_seg, last_seg, words) of segments (file_id, seg_no, words)."""
    tables = Tables(rows.sparkSession)
    sums = tables.write(placed(rows), "budget-sums")
    ends = next_chunks(sums, max_words)
    # The next chunk begins at the segment after the last one.
    after = Window.partitionBy("file_id", F.expr(f"seg_no div {ROWS_PER_BLOCK}")).orderBy("seg_no")
    firsts = sums.groupBy("file_id", F.expr(f"seg_no div {ROWS_PER_BLOCK}").alias("block")).agg(F.min("seg_no").alias("first"))
    across = firsts.withColumn("next_block", F.lead("first").over(Window.partitionBy("file_id").orderBy("block"))).select("file_id", "block", "next_block")
    follows = _met(sums.select("file_id", "seg_no", F.expr(f"seg_no div {ROWS_PER_BLOCK}").alias("block"), F.lead("seg_no").over(after).alias("inside")), across, ["file_id", "block"])
    follows = follows.select("file_id", F.col("seg_no").alias("last"), F.coalesce("inside", "next_block").alias("to"))
    jumps = tables.write(_met(ends, follows, ["file_id", "last"]).select("file_id", F.col("seg_no").alias("from"), "to", "last"), "budget-jumps")
    reached = tables.write(sums.groupBy("file_id").agg(F.min("seg_no").alias("from")), "budget-starts")
    step = tables.write(jumps.where("to IS NOT NULL").select("file_id", "from", "to"), "budget-steps")
    while not step.isEmpty():
        found = _met(reached, step, ["file_id", "from"]).select("file_id", F.col("to").alias("from"))
        further = _met(step.select("file_id", "from", F.col("to").alias("via")), step.select("file_id", F.col("from").alias("via"), "to"), ["file_id", "via"])
        old, reached = reached, tables.write(reached.unionByName(found), "budget-starts")
        used, step = step, tables.write(further.select("file_id", "from", "to"), "budget-steps")
        tables.drop(old, used)
    tables.drop(step)
    starts = _met(reached, jumps, ["file_id", "from"]).select("file_id", F.col("from").alias("first_seg"), F.col("last").alias("last_seg"))
    words = _met(starts, sums.select("file_id", F.col("seg_no").alias("first_seg"), "at"), ["file_id", "first_seg"])
    words = _met(words, sums.select("file_id", F.col("seg_no").alias("last_seg"), "upto"), ["file_id", "last_seg"])
    return _numbered(words.select("file_id", "first_seg", "last_seg", (F.col("upto") - F.col("at")).alias("words"), F.expr(f"at div {max_words * ROWS_PER_BLOCK}").alias("block")))


def _numbered(chunks: DataFrame) -> DataFrame:
    """Number the chunks of a file, by blocks of words and then within them."""
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = chunks.groupBy("file_id", "block").agg(F.count("*").alias("k")).select("file_id", "block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file_id", "block").orderBy("first_seg")
    rows = _met(chunks.withColumn("i", F.row_number().over(inside)), base, ["file_id", "block"])
    return rows.select("file_id", (F.col("base") + F.col("i") - 1).alias("chunk_no"), "first_seg", "last_seg", "words")
