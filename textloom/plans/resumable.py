"""A translation job that can be paused, cancelled, watched and taken up again.

The segments of a job's files are staged once as files of a bounded number of rows. A streaming query with a checkpoint takes one
of them after another; each micro-batch leaves out the segments that the result log already holds, calls the translator for the
rest and adds their results to the log under the batch's number. Between batches the job's control is asked, and a row of progress
is written. A job that was killed goes on with the batch that was open: no finished batch calls the translator again.

The bound on calls at a time holds for the whole job: a batch's rows are dealt to as many slots as calls are allowed, a slot is
one task, and a task calls for one row after another.

Defined cases: a job without segments is done at once; segments that need no call (blank, not translatable) count as processed;
a job that is cancelled before it starts calls nothing; a cancelled job keeps its results and may be started again; the glossary's
terms reach the prompt of their job. Ids of a job's files must be unique.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.translate import TransformOptions, Translator, translate_segments
from ..schema import ERROR, SEGMENTS
from ..session import delete_folder
from ..sources import EXTRACTORS, with_types
from ..streaming.control import Cancelled, JobControl
from .jobs import TEXT_TYPES, outputs_of_type

_STAGED = T.StructType([*SEGMENTS.fields, T.StructField("type", T.StringType()), T.StructField("prompt", T.StringType())])
_LOG = "file_id long, seg_no int, translated string, ok boolean, error string, batch long"
_PROGRESS = "batch long, processed long, failed long, total long, at timestamp"


@dataclass
class ResumableJob:
    """One job under `folder`, which all executors share; everything that it needs to go on is there."""

    spark: SparkSession
    job: int
    folder: str
    translator: Translator
    options: TransformOptions = TransformOptions()
    control: JobControl = field(default_factory=JobControl)
    rows_per_batch: int = 10_000
    types: tuple[str, ...] = TEXT_TYPES

    def _path(self, name: str) -> str:
        return f"{self.folder}/job-{self.job}/{name}"

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _read(self, name: str, schema) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name))

    def stage(self, files: DataFrame, prompt: str | None = None) -> None:
        """Write the files and their segments, once; a job that is staged already is left as it is."""
        if self._exists("segments/_SUCCESS"):
            return
        typed = with_types(files).select("file_id", "content", "type")
        typed.write.mode("overwrite").parquet(self._path("files"))
        typed = self.spark.read.schema(typed.schema).parquet(self._path("files"))
        parts = [EXTRACTORS[kind](typed.where(F.col("type") == kind)).withColumn("type", F.lit(kind)) for kind in self.types]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows = rows.withColumn("prompt", F.lit(prompt).cast("string")).select(*[F.col(f.name).cast(f.dataType) for f in _STAGED.fields])
        rows.write.mode("overwrite").option("maxRecordsPerFile", self.rows_per_batch).parquet(self._path("segments"))

    def _calls(self) -> DataFrame:
        """Segments that go to the translator."""
        return self._read("segments", _STAGED).where((F.col("kind") != ERROR) & F.col("translatable"))

    def run(self) -> str:
        """Work until the job is done or cancelled; gives its state. What a killed run has finished is not done again."""
        if not self.control.known(self.job):
            self.control.register(self.job)
        if self.control.state(self.job) == "cancelled":
            return "cancelled"
        total = self._calls().count()
        rows = self.spark.readStream.schema(_STAGED).option("maxFilesPerTrigger", 1).parquet(self._path("segments"))
        stream = rows.writeStream.queryName(f"textloom-job-{self.job}").option("checkpointLocation", self._path("checkpoint"))
        query = stream.foreachBatch(lambda batch, number: self._finish(batch, number, total)).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            if self.control.state(self.job) == "cancelled":
                return "cancelled"
            raise
        return "completed"

    def _finish(self, batch: DataFrame, number: int, total: int) -> None:
        self.control.wait(self.job)
        slots = min(8, max(1, self.options.concurrency))
        one = TransformOptions(**{**self.options.__dict__, "concurrency": 1})
        done = self._read("log", _LOG).where(F.col("batch") != number).select("file_id", "seg_no")
        open_rows = batch.where((F.col("kind") != ERROR) & F.col("translatable")).join(done, ["file_id", "seg_no"], "left_anti")
        # A fixed number of partitions is a slot each, and a task calls for one row after another.
        results = translate_segments(open_rows.repartition(slots), self.translator, one)
        results.select("file_id", "seg_no", "translated", "ok", "error").write.mode("overwrite").parquet(self._path(f"log/batch={number}"))
        counts = self._read("log", _LOG).agg(F.count("*").alias("processed"), F.count_if(~F.col("ok")).alias("failed"))
        row = counts.select("processed", "failed", F.lit(total).cast("long").alias("total"), F.current_timestamp().alias("at"))
        row.coalesce(1).write.mode("overwrite").parquet(self._path(f"progress/batch={number}"))

    def progress(self) -> DataFrame:
        """(batch, processed, failed, total, at, progress): a row for each batch that is done, as soon as it is; failed calls count as processed here."""
        share = F.when(F.col("total") == 0, 100.0).otherwise(F.col("processed") / F.col("total") * 100)
        return self._read("progress", _PROGRESS).withColumn("progress", share)

    def results(self) -> DataFrame:
        """The staged segments with `translated`, `ok` and `error`; what has not been called yet keeps its text."""
        log = self._read("log", _LOG).drop("batch")
        rows = self._read("segments", _STAGED).drop("prompt").join(log, ["file_id", "seg_no"], "left")
        return rows.withColumns({"translated": F.coalesce("translated", "text"), "ok": F.coalesce("ok", F.lit(True))})

    def outputs(self) -> DataFrame:
        """The rebuilt files, as `translate_files` gives them."""
        files = self.spark.read.parquet(self._path("files"))
        rows = self.results()
        parts = [outputs_of_type(files.where(F.col("type") == kind).select("file_id", "content"), rows.where(F.col("type") == kind).drop("type"), kind) for kind in self.types]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def forget(self) -> None:
        """Delete all that the job has written."""
        delete_folder(self.spark, self._path(""))


__all__ = ["Cancelled", "ResumableJob"]
