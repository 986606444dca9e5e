"""Exact top-k with large components, repeated rows and repeated ids, against its SQL and against Python's whole numbers."""

import math
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textloom.llm import queries, va_topk

SMALL = va_topk.TopkOptions(queries_per_block=3, vectors_per_block=20, cells=4)


def _table(seed, largest):
    rng = random.Random(seed)
    vectors = [[rng.uniform(-largest, largest) for _ in range(6)] for _ in range(60)]
    rows = [(i, vectors[i % 60]) for i in range(90)]
    rows += [(i, [x + rng.random() / 512 for x in vectors[0]]) for i in range(90, 130)]  # nearly equal scores
    rows += [(5, vectors[5])] * 3 + [(100, vectors[7])] * 2 + [(0, vectors[9]), (0, vectors[0]), (200, vectors[1])] + [(300 + i // 30, vectors[2]) for i in range(60)]
    return rows + [(400, None), (401, [1.0, None, 0, 0, 0, 0]), (402, [math.nan] * 6), (403, [math.inf] * 6), (404, []), (None, vectors[0]), (405, [1.0])]


@pytest.mark.parametrize(("options", "largest"), [(va_topk.TopkOptions(), 1e6), (SMALL, 1.0), (SMALL, 3e5), (SMALL, 1e6)])
def test_large_components_and_repeated_rows_as_in_sql(spark, tmp_path, largest, options):
    rows = [r for r in _table(1, largest) if r[1] is None or len(r[1]) != 1]
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))}), f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet' WHERE vec_id IS NOT NULL")
    want = Counter(con.execute(queries.ORACLE_SQL["op4_topk"]).fetchall())
    found = va_topk.exact_topk(spark.read.parquet(f"{tmp_path}/embeddings.parquet").withColumn("times", F.lit(9)), F.col("vec_id") % 100 == 0, options)
    assert Counter(map(tuple, found.collect())) == want and len(want) >= 40


@pytest.mark.parametrize("largest", [3e10])
def test_sums_that_no_long_holds_on_the_way(spark, largest):
    """Partial sums beyond a long whose end fits one; scores by Python's whole numbers."""
    rng = random.Random(3)
    half = [[rng.uniform(-largest, largest) for _ in range(3)] for _ in range(50)]
    rows = [(i, [*h, *(x if i % 2 else -x + rng.random() for x in h)]) for i, h in enumerate(half)]
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=True))
    queries_ = [q for q in whole if all(abs(score(q, i)) < 1 << 63 for i in whole if i != q)]
    if not queries_:
        queries_ = [0]
        rows = [(i, v) for i, v in rows if i == 0 or abs(score(0, i)) < 1 << 63]
    want = {(q, r + 1, i, s) for q in queries_ for r, (s, i) in enumerate(sorted(((score(q, i), i) for i, _ in rows if i != q), key=lambda x: (-x[0], x[1]))[:10])}
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in va_topk.exact_topk(data, F.col("vec_id").isin(queries_), SMALL).collect()} == want


def test_order_beyond_doubles(spark):
    rows = [(0, [300000.1, 300000.3]), (1, [300000.1, 300000.7]), (2, [300000.1, 300000.8]), (3, [300000.1, 300000.9])]
    found = va_topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == [3, 2, 1]
