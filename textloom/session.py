"""A session with the settings that the library is tuned for; any session works."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "textloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder for tables of one job: below the one that `spark.checkpoint.dir` names, which all executors share.

    Where none is named, local mode has one of its own; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named}/textloom"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="textloom-"))
    return _LOCAL[0]


def spread(rows: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores, for work that costs more than moving them; a scan that has more stays."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


#: Rows and bytes of an Arrow batch: whole files may be long. They replace Spark's own values; a caller's other values stay.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "64"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def small_batches(spark: SparkSession | None = None) -> None:
    """Keep Arrow batches small, so that a Python worker holds a few texts at a time whatever the table's size."""
    spark = spark or SparkSession.active()
    for key, (usual, small) in ARROW_BATCH.items():
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, small)


def dealt(spark: SparkSession) -> int:
    """Over how many tasks joined rows are dealt whose work costs far more than their bytes say."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


class Tables:
    """Tables that a job writes on its way into the shared folder, so that nothing is worked out twice and no lineage grows."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables; nothing may read them any more."""
        for table in tables:
            _, path = self._paths.pop(id(table))
            delete_folder(self.spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
