"""Language identification with bit-sliced Bloom filters.

A slot of the filter holds one bit for each language, so one lookup (the AND of an n-gram's slots) gives all languages whose
characteristic n-grams contain it. Per-language counts of these bits over a text, corrected for the share of false positives
that the language's fill predicts, decide.

Learning sees a bounded sample (`FitOptions`); prediction reads whole texts.

Defined cases: a text that is null or has no letter is `und` with score 0; a text whose n-grams no language knows gets the most
frequent learnt language with score 0; ties go to the smaller name; without training rows all is `und`; rows with null language
teach nothing; repeated rows are predicted once each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, prepare, string_columns

WORD = 64  # languages in one word of a slot


@dataclass(frozen=True)
class FitOptions:
    docs_per_language: int = 3000
    grams_per_language: int = 60_000
    sizes: tuple[int, ...] = (3, 4)
    least_count: int = 3
    least_share: float = 0.5  # of the n-gram's highest relative frequency in any language
    hashes: int = 3
    slots_per_gram: int = 12


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    slots: np.ndarray  # by word: one word of bits each, for as many words as the languages need
    false_share: np.ndarray  # by language
    sizes: tuple[int, ...]
    hashes: int
    usual: int


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts, runs of anything else as one blank; and where each text starts."""
    raw = [np.frombuffer((" " + (t or "").lower() + " ").encode("utf-32-le", "replace"), np.uint32) for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    codes = np.concatenate(raw)
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    keep[np.concatenate([[0], ends[:-1]])] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], kept[np.concatenate([[0], ends])]


def _grams(codes: np.ndarray, starts: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: hashes of the n-grams that hold a blank at their ends at most, and the text that each belongs to."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    blank = codes == 32
    wide = codes.astype(np.uint64)
    for size in sizes:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        key = np.full(n, size, np.uint64)
        for j in range(size):
            key = key * np.uint64(0x100000001B3) + wide[j : j + n]
        good = owner[:n] == owner[size - 1 :]
        for j in range(1, size - 1):
            good &= ~blank[j : j + n]
        yield mix(key[good]), owner[:n][good]


def _slots(grams: np.ndarray, count: int, hashes: int) -> Iterator[np.ndarray]:
    step = (grams >> np.uint64(32)) | np.uint64(1)
    for i in range(hashes):
        yield (grams + np.uint64(i) * step) & np.uint64(count - 1)


def fit_languages(docs: DataFrame, options: FitOptions = FitOptions()) -> LanguageModel:
    """Learn from (doc_id, text, lang); the caller gives only rows that may be learnt from."""
    o, spark = options, prepare(docs.sparkSession)
    rows = string_columns(docs, "doc_id", "text", "lang").where("lang IS NOT NULL AND text != ''")
    counted = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(counted)
    if not names:
        return LanguageModel((), np.zeros((1, 1), np.uint64), np.zeros(0), o.sizes, o.hashes, 0)
    # The sample is the first ids by hash; a threshold on the hash thins a common language out before its ids are ordered.
    least = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, 1.5 * o.docs_per_language / counted[n] + 1e-4))]), F.col("lang"))
    ids = rows.select("doc_id", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isin(names))
    ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < least * (1 << 20))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "doc_id")
    ids = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= o.docs_per_language)
    chosen = [(r.doc_id, r.lang) for r in ids.select("doc_id", "lang").distinct().collect()]  # bounded by docs_per_language
    texts = rows.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, lang string")), ["doc_id", "lang"], "left_semi").select("text", "lang")
    code = {x: i for i, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([code[x] for x in batch.column(1).to_pylist()])
            codes, starts = _codes(batch.column(0).to_pylist())
            for grams, owner in _grams(codes, starts, o.sizes):
                for k in np.unique(langs):
                    found, times = np.unique(grams[langs[owner] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), k, np.int32)), pa.array(times, pa.int64())], names=["gram", "k", "n"])

    counts = texts.mapInArrow(count, "gram long, k int, n long").groupBy("gram", "k").agg(F.sum("n").alias("n"))
    totals = {r.k: r.t for r in texts.groupBy("lang").agg(F.sum(F.length("text")).alias("t")).selectExpr("lang as k", "t").collect()}
    share = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for n in names for x in (code[n], float(max(1, totals.get(n, 1))))]), F.col("k"))
    counts = counts.where(F.col("n") >= o.least_count).withColumn("share", share)
    most = counts.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= o.least_share * F.col("most"))
    best = most.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("share"), "gram"))).where(F.col("r") <= o.grams_per_language)
    found = best.select("gram", "k").toPandas()  # bounded by grams_per_language for each language
    per_language = found["k"].value_counts()
    size = 1 << max(10, int(np.ceil(np.log2(max(1, per_language.max() if len(found) else 1) * o.slots_per_gram))))
    slots = np.zeros((-(-len(names) // WORD), size), np.uint64)
    grams, k = found["gram"].to_numpy(np.int64).view(np.uint64), found["k"].to_numpy(np.int64)
    for at in _slots(grams, size, o.hashes):
        np.bitwise_or.at(slots, (k // WORD, at.astype(np.int64)), np.uint64(1) << (k % WORD).astype(np.uint64))
    fill = np.array([((slots[k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)).mean() for k in range(len(names))])
    usual = max(range(len(names)), key=lambda k: totals.get(names[k], 0))
    narrow = np.uint8 if len(names) <= 8 else np.uint64
    return LanguageModel(tuple(names), slots.astype(narrow), fill**o.hashes, o.sizes, o.hashes, usual)


def predict_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    n, languages = len(texts), model.languages
    codes, starts = _codes(texts)
    has_letters = np.add.reduceat(codes != 32, starts[:-1]) > 0 if n else np.zeros(0, bool)
    hits, total = np.zeros((len(languages), n)), np.zeros(n)
    for grams, owner in _grams(codes, starts, model.sizes):
        total += np.bincount(owner, minlength=n)
        places = [at.astype(np.int64) for at in _slots(grams, model.slots.shape[1], model.hashes)]
        for word, row in enumerate(model.slots):
            masks = np.bitwise_and.reduce([row[at] for at in places])
            for k in range(word * WORD, min(len(languages), (word + 1) * WORD)):
                hits[k] += np.bincount(owner, (masks >> masks.dtype.type(k % WORD)) & masks.dtype.type(1), minlength=n)
    share = np.zeros((len(languages), n))
    for k, f in enumerate(model.false_share):
        share[k] = np.clip((hits[k] - total * f) / np.maximum(1, total) / max(1e-9, 1 - f), 0, 1)
    if not languages:
        return ["und"] * n, np.zeros(n)
    best, sums = share.argmax(axis=0), share.sum(axis=0)
    best = np.where(sums > 0, best, model.usual)
    score = np.where(sums > 0, share.max(axis=0) / np.maximum(1e-12, sums), 0.0)
    return [languages[b] if ok else "und" for b, ok in zip(best, has_letters, strict=True)], np.where(has_letters, score, 0.0)


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of (doc_id, text)."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), 128):
                a, b = predict_texts(texts[i : i + 128], shared.value)
                names += a
                scores.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return string_columns(docs, "doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
