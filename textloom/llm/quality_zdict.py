"""Quality classifier by compression.

Two Zstandard dictionaries are built, one from pieces of good and one from pieces of bad labelled text. A text is compressed
piece by piece under each; (bad - good) / (bad + good) over its whole length is turned into a probability by a logistic curve
fitted on labelled documents that gave no piece to the dictionaries.

Learning sees a bounded sample: `FitOptions` documents the bounds. Scoring sees every byte of every text.

Defined cases: null and empty texts have difference 0 and get the curve's value there; a document whose label rows disagree or
are null teaches nothing; with no labels of one class every score is the share of label 1 (0.5 without labels); repeated rows
are scored once each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import prepare, string_columns


@dataclass(frozen=True)
class FitOptions:
    docs_per_class: int = 4000  # labelled documents looked at
    pieces_per_class: int = 8000  # pieces that reach the driver
    piece_bytes: int = 512
    dictionary_bytes: int = 32768
    level: int = 1


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    shift: float
    piece_bytes: int
    level: int


_COMPRESSORS: dict = {}


def _compressors(model: QualityModel) -> list:
    import zstandard

    key = hash(model)
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        made = []
        for raw in (model.good, model.bad):
            words = zstandard.ZstdCompressionDict(raw)
            words.precompute_compress(level=model.level)
            made.append(zstandard.ZstdCompressor(dict_data=words, level=model.level, write_checksum=False, write_content_size=False, write_dict_id=False))
        _COMPRESSORS[key] = made
    return _COMPRESSORS[key]


def _difference(data: bytes, model: QualityModel) -> float:
    if not model.good:
        return 0.0
    good, bad = _compressors(model)
    g = b = 0
    for i in range(0, len(data), model.piece_bytes):
        piece = data[i : i + model.piece_bytes]
        g += len(good.compress(piece))
        b += len(bad.compress(piece))
    return (b - g) / (b + g) if b + g else 0.0


def _differences(column: pa.Array, model: QualityModel) -> np.ndarray:
    return np.array([_difference(x.as_buffer().to_pybytes() if x.is_valid else b"", model) for x in column], float)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method with a slight pull to 0, on the standardised difference."""
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    design = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - y) + 1e-3 * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def _sample_ids(labels: DataFrame, per_class: int) -> DataFrame:
    """A bounded sample of labelled ids: the first by a hash of the id, in each class."""
    clear = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    first = [clear.where(F.col("q") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return first[0].unionByName(first[1]).select("doc_id", "q")


def fit_quality(docs: DataFrame, labels: DataFrame, options: FitOptions = FitOptions()) -> QualityModel:
    """Learn from labels (doc_id, quality); the caller gives only rows that may be learnt from."""
    import zstandard

    prepare(docs.sparkSession)
    o = options
    ids = _sample_ids(string_columns(labels, "doc_id", "quality"), o.docs_per_class)
    chosen = [(r.doc_id, r.q) for r in ids.collect()]  # bounded by docs_per_class
    if len({q for _, q in chosen}) < 2:
        share = np.mean([q for _, q in chosen]) if chosen else 0.5
        return QualityModel(b"", b"", 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))), o.piece_bytes, o.level)
    named = docs.sparkSession.createDataFrame(chosen, "doc_id long, q int")
    texts = string_columns(docs, "doc_id", "text").where("text != ''").join(F.broadcast(named), "doc_id")
    fits = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) != 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, classes = [], []
            for text, q in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                made = [data[i : i + o.piece_bytes] for i in range(0, len(data), o.piece_bytes)]
                pieces += made
                classes += [q] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()), pa.array(classes, pa.int32())], names=["piece", "q"])

    pieces = texts.where(fits).select("text", "q").mapInArrow(cut, "piece binary, q int").where("length(piece) >= 64")
    pieces = pieces.dropDuplicates(["piece", "q"])
    trained = []
    for k in (1, 0):
        part = [bytes(r.piece) for r in pieces.where(F.col("q") == k).select("piece").orderBy(F.xxhash64("piece"), "piece").limit(o.pieces_per_class).collect()]
        trained.append(_dictionary(zstandard, part, o.dictionary_bytes))
    model = QualityModel(trained[0], trained[1], 1.0, 0.0, o.piece_bytes, o.level)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_differences(batch.column(0), model)), batch.column(1)], names=["x", "q"])

    held = texts.where(~fits).select("text", "q").mapInArrow(measure, "x double, q int").limit(4 * o.docs_per_class).toPandas()
    if held["q"].nunique() < 2:
        return QualityModel(model.good, model.bad, 40.0, 0.0, o.piece_bytes, o.level)
    slope, shift = _logistic(held["x"].to_numpy(), held["q"].to_numpy(float))
    return QualityModel(model.good, model.bad, slope, shift, o.piece_bytes, o.level)


def _dictionary(zstandard, pieces: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the pieces themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size]


def score_quality(docs: DataFrame, model: QualityModel, keep: float | None = None) -> DataFrame:
    """Add `quality_score` to every row of `docs`; with `keep`, return only rows that reach it, without the score."""
    prepare(docs.sparkSession)
    names = docs.columns
    at = names.index("text")
    out = docs.schema if keep is not None else StructType([*docs.schema.fields, StructField("quality_score", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = 1 / (1 + np.exp(-np.clip(model.slope * _differences(batch.column(at), model) + model.shift, -500, 500)))
            if keep is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*names, "quality_score"])
            else:
                yield batch.filter(pa.array(values >= keep))

    return docs.mapInArrow(score, out)
