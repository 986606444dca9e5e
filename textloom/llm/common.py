"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches

def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small and make sure that a checkpoint folder exists."""
    small_batches(spark)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; in local mode, where none is named, a folder of our own (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="textloom-checkpoint-"))
    return named or jsc.getCheckpointDir().get()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: lineage is cut, and a lost executor costs nothing."""
    return Scratch(df.sparkSession).write(df, name)


_WRITTEN: set[str] = set()  # scratch tables of this process that are not deleted yet


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.discard(path)


class Scratch:
    """Written tables of one call of an operator. `clear` deletes those that its result does not read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{checkpoint_dir(self.spark)}/textloom/{name}-{uuid.uuid4().hex}"
        _WRITTEN.add(path)
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def clear(self, *keep: DataFrame) -> None:
        kept = {id(df) for df in keep}
        for key, (_, path) in list(self.paths.items()):
            if key not in kept:
                _delete(self.spark, path)
                del self.paths[key]


def stored(make, name: str) -> DataFrame:
    """Write what `make()` returns and delete every scratch table that making it has left: those that its plan still read."""
    before = set(_WRITTEN)
    made = make()
    scratch = Scratch(made.sparkSession)
    table = scratch.write(made, name)
    (own,) = (path for _, path in scratch.paths.values())
    for path in _WRITTEN - before - {own}:
        _delete(made.sparkSession, path)
    return table


def string_columns(table: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns never clash with an operator's own."""
    return table.select(*[F.col(f"`{n}`") for n in names])


# --- vectorised word and shingle hashes over an Arrow string column ---------------------------------------------------

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.default_rng(20240229)
_TABLED = 64  # bytes of a word that have random numbers of their own, by place and value
_NUMBERS = _RNG.integers(0, 2**64, _TABLED * 256, dtype=np.uint64)
_SLOT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the offsets of the rows in them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the ASCII-lower-cased words: sums of random numbers of each place and byte, for words beyond 64 bytes xxh3; first word number of each row (and the total), byte starts and ends."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), none, none
    solid = ~_WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~solid[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    first = np.searchsorted(starts, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), first, starts, ends
    lens = ends - starts
    at = np.zeros(len(starts), np.int64)
    np.cumsum(lens[:-1], out=at[1:])
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    values = _NUMBERS[(place & (_TABLED - 1)) << 8 | _LOWER[data[solid]]]
    hashes = mix(np.add.reduceat(values, at) + lens.astype(np.uint64))
    for i in np.flatnonzero(lens > _TABLED).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(_LOWER[data[starts[i] : ends[i]]].tobytes(), seed=_TABLED)
    return hashes, first, starts, ends


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words; runs may cross rows, the caller drops those."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += mix(words[j : j + n] ^ _SLOT[j]) * _SLOT[j + 7]
    return mix(total + np.uint64(size))


def row_shingles(words: np.ndarray, first: np.ndarray, size: int = 5):
    """Yield each row's distinct shingle hashes, sorted; a row of fewer words has its whole sequence as one shingle."""
    runs = window_hashes(words, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            yield window_hashes(words[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
