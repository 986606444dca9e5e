"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon is learnt first: words whose share of toxic documents is high even at the lower end of what their numbers allow. A
word's support is the smaller of its toxic documents and of the words that it follows in them, so that a passage copied over
many documents supports nothing. A text then has sixteen features: densities of lexicon words (weighted, distinct, disguised by
digits, marks, stretched or spaced letters), how near a second person stands to them, shares of capitals, punctuation and
disguise, and lengths. Features of a labelled document are taken with a lexicon that was learnt without its fold, and the curve
from tree scores to probabilities is fitted on scores of trees that were fitted without its fold.

Learning sees a bounded sample of labelled documents (`ToxicityOptions.docs`); scoring reads every word of every text.

Defined cases: null and empty texts have zeros for features and get the score of those; a document whose label rows disagree or
are null teaches nothing, and one whose id has several rows teaches by one of them; without labels of both classes every score
is the share of label 1 (0 without labels); with too few of a class to leave a fold out, the curve is fitted on the trees' own
documents; repeated rows are scored once each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepare, string_columns


@dataclass(frozen=True)
class ToxicityOptions:
    docs: int = 20_000  # labelled documents learnt from
    lexicon_words: int = 5_000
    min_support: int = 3
    min_share: float = 0.5  # of toxic documents among a word's, at the lower end
    folds: int = 3
    trees: int = 12
    depth: int = 3
    seed: int = 17


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    share: float


# Words for the second person in English, German, French and Spanish, and marks that stand for letters.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer eure sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split()
)
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e"})

NEAR = 8  # words
LONG_WORD = 64
CACHE_WORDS = 50_000
_STRETCHED = re.compile(r"(.)\1{2,}")
_PART = re.compile(r"[^\W_]+")
#: What is noted of a word: weight and hits in plain and in disguise, second person, letters, capitals, and so on.
FACTS = ("weight", "hit", "disguised", "second", "letters", "upper", "shouted", "marks", "calls", "mixed", "stretched", "single", "chars")
FEATURES = ("density", "distinct", "strongest", "hits", "disguised", "second", "nearness", "upper", "shouted", "calls", "marks", "mixed", "stretched", "spaced", "words", "word_length")


class _Words:
    """Facts of words, worked out once each; `number` gives a word's row in `facts`."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.bare = {_STRETCHED.sub(r"\1", w): v for w, v in lexicon.items()}
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = array("d")  # as many numbers for each word as there are facts
        self.names: dict[int, str] = {}  # of words that hit

    def look_up(self, word: str) -> int:
        found = self.number.get(word)
        if found is None:
            found = len(self.rows) // len(FACTS)
            facts, name = self._facts(word)
            self.rows.extend(facts)
            if name:
                self.names[found] = name
            if len(word) <= LONG_WORD:
                self.number[word] = found
        return found

    def _facts(self, word: str) -> tuple[tuple[float, ...], str]:
        parts = _PART.findall(word.lower())
        hits = [p for p in parts if p in self.lexicon]
        letters = sum(map(str.isalpha, word))
        upper = sum(map(str.isupper, word))
        inner = word.strip(".,;:!?\"'()[]{}«»…*#%&|~-_")
        mixed = bool(parts) and not inner.isalpha() and any(map(str.isalpha, inner)) and (len(parts) > 1 or any(not c.isalpha() for c in inner))
        stretched = _STRETCHED.search(inner.lower()) is not None
        name, weight, disguised = "", 0.0, 0.0
        if hits:
            name = max(hits, key=self.lexicon.__getitem__)
            weight = self.lexicon[name]
        elif (mixed or stretched) and len(word) <= LONG_WORD:
            for form in (inner, word):
                plain = "".join(filter(str.isalpha, form.lower().translate(DISGUISE)))
                name = plain if plain in self.lexicon else _STRETCHED.sub(r"\1", plain)
                weight = self.lexicon.get(name) or self.bare.get(name, 0.0)
                if weight:
                    disguised = 1.0
                    break
        if not weight:
            name = ""
        second = float(any(p in SECOND_PERSON for p in parts))
        marks = sum(1 for c in word if not c.isalnum())
        return (
            weight, float(weight > 0), disguised, second, float(letters), float(upper), float(upper == letters > 2), float(marks),
            float(word.count("!") + word.count("?")), float(mixed), float(stretched), float(len(inner) == 1 and inner.isalpha()), float(len(word)),
        ), name

    def features(self, text: str) -> list[float]:
        words = text.split()
        if not words:
            return [0.0] * len(FEATURES)
        if len(self.rows) > CACHE_WORDS * len(FACTS):
            self.clear()
        rows = np.fromiter(map(self.look_up, words), np.int64, len(words))
        used, at = np.unique(rows, return_inverse=True)
        table = np.frombuffer(self.rows).reshape(-1, len(FACTS))[used]
        times = np.bincount(at)
        total = dict(zip(FACTS, times @ table, strict=True))
        column = {name: table[:, i] for i, name in enumerate(FACTS)}
        distinct = {self.names[i] for i in used[column["hit"] > 0].tolist()}
        strongest = float(column["weight"].max())
        hit_at = np.flatnonzero(column["hit"][at])
        # Letters with blanks between them.
        single = np.concatenate([[0], column["single"][at], [0]])
        starts, ends = np.flatnonzero(np.diff(single) > 0), np.flatnonzero(np.diff(single) < 0)
        spaced = 0
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a >= 3:
                spaced += b - a
                name = "".join(filter(str.isalpha, "".join(words[a : min(b, a + LONG_WORD)]).lower()))
                if name in self.lexicon:
                    distinct.add(name)
                    strongest = max(strongest, self.lexicon[name])
                    total["weight"] += self.lexicon[name]
                    total["hit"] += 1
                    total["disguised"] += 1
                    hit_at = np.append(hit_at, a)
        said_at = np.flatnonzero(column["second"][at])
        nearness = 0.0
        if len(hit_at) and len(said_at):
            after = np.searchsorted(said_at, hit_at)
            gaps = np.minimum(np.abs(said_at[np.minimum(after, len(said_at) - 1)] - hit_at), np.abs(said_at[np.maximum(after - 1, 0)] - hit_at))
            nearness = float(np.where(gaps <= NEAR, 1 / (1 + gaps), 0).sum() / len(hit_at))
        n, letters = len(words), max(total["letters"], 1.0)
        return [
            total["weight"] / n, float(len(distinct)), strongest, math.log1p(total["hit"]), total["disguised"] / n, total["second"] / n, nearness, total["upper"] / letters,
            total["shouted"] / n, total["calls"] / n, total["marks"] / total["chars"], total["mixed"] / n, total["stretched"] / n, spaced / n, math.log1p(n), total["chars"] / n,
        ]


_KNOWN: dict[int, tuple[dict[str, float], _Words]] = {}


def _words_of(lexicon: dict[str, float]) -> _Words:
    """One for each Python worker and lexicon, so that words are worked out once."""
    key = hash(tuple(sorted(lexicon.items())))
    if key not in _KNOWN:
        if len(_KNOWN) > 8:
            _KNOWN.clear()
        _KNOWN[key] = (lexicon, _Words(lexicon))
    return _KNOWN[key][1]


def with_features(docs: DataFrame, lexicons: dict[int, dict[str, float]]) -> DataFrame:
    """Add `x`, the features, to rows with `text` and `fold`, taken with the lexicon of the row's fold."""
    at, fold_at, names = docs.columns.index("text"), docs.columns.index("fold"), [c for c in docs.columns if c != "text"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {fold: _words_of(lexicon) for fold, lexicon in lexicons.items()}
        for batch in batches:
            x = [words[fold].features(text or "") for text, fold in zip(batch.column(at).to_pylist(), batch.column(fold_at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))], names=[*names, "x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(measure, f"{schema}, x array<double>")


def _lexicons(sample: DataFrame, o: ToxicityOptions, scratch: Scratch) -> dict[int, dict[str, float]]:
    """A lexicon learnt without each fold, and under -1 one learnt from all rows (text, y, fold).

    A document gives each of its words once, and words are summed up before they are shuffled. Words of clean documents count only
    where toxic ones have them often enough.
    """
    lexicons = range(-1, o.folds)
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0)
    toxic = sample.where("y = 1").select("fold", words.alias("w"))
    pairs = F.zip_with("w", F.concat(F.array(F.lit("")), "w"), lambda word, before: F.struct(word.alias("word"), before.alias("before")))
    pairs = toxic.select("fold", F.inline(F.array_distinct(F.filter(pairs, lambda p: F.length(p.word) >= 3))))
    # In which folds a word follows another, as bits.
    places = pairs.groupBy("word", "before").agg(F.bit_or(F.expr("shiftleft(1, fold)")).alias("folds"))
    others = lambda k: F.col("folds").bitwiseAND(F.lit(~(1 << k) if k >= 0 else -1)) != 0
    places = places.groupBy("word").agg(*[F.count_if(others(k)).alias(f"places{k}") for k in lexicons])
    counted = lambda rows, name: rows.groupBy("word").agg(*[F.count_if(F.col("fold") != k).alias(f"{name}{k}") for k in lexicons])
    distinct = lambda rows: rows.select("fold", F.explode(F.array_distinct("w")).alias("word")).where(F.length("word") >= 3)
    often = counted(distinct(toxic), "toxic").where(F.col("toxic-1") >= o.min_support).join(places.where(F.col("places-1") >= o.min_support), "word")
    clean = distinct(sample.where("y = 0").select("fold", words.alias("w"))).join(often.select("word"), "word", "left_semi")
    counts = scratch.write(often.join(counted(clean, "clean"), "word", "left").fillna(0), "words")

    found: dict[int, dict[str, float]] = {}
    z = 1.64
    for k in lexicons:
        support = F.least(f"toxic{k}", f"places{k}").cast("double")
        n = support + F.col(f"clean{k}")
        share = support / n
        low = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        rated = counts.where(support >= o.min_support).select("word", low.alias("low")).where(F.col("low") >= o.min_share)
        found[k] = {r.word: r.low for r in rated.orderBy(F.desc("low"), "word").limit(o.lexicon_words).collect()}
    return found


def fit_toxicity(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions()) -> ToxicityModel:
    """Learn from labels (doc_id, toxic); the caller gives only rows that may be learnt from."""
    o, spark = options, prepare(docs.sparkSession)
    scratch = Scratch(spark)
    clear = string_columns(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2")).where("y = y2")
    chosen = [(r.doc_id, r.y) for r in clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(o.docs).collect()]  # bounded by the option
    named = spark.createDataFrame(chosen, "doc_id long, y int")
    texts = string_columns(docs, "doc_id", "text").where("text != ''").join(F.broadcast(named), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(o.folds)).cast("int")
    # One text for each id.
    texts = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("fold", fold)
    sample = scratch.write(texts, "labelled")
    sizes = {(r.fold, r.y): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
    total = [sum(n for (_, y), n in sizes.items() if y == k) for k in (0, 1)]
    share = total[1] / sum(total) if sum(total) else 0.0
    if not all(total):
        scratch.clear()
        return ToxicityModel({}, None, None, share)
    lexicons = _lexicons(sample, o, scratch)
    rows = scratch.write(with_features(sample, lexicons), "features")
    rows = rows.select("doc_id", "fold", F.col("y").cast("double").alias("label"), array_to_vector("x").alias("features")).coalesce(1).sortWithinPartitions("doc_id")
    booster = GBTClassifier(maxIter=o.trees, maxDepth=o.depth, stepSize=0.3, minInstancesPerNode=3, seed=o.seed)
    trees = booster.fit(rows)
    left_out = all(total[y] > sizes.get((k, y), 0) for k in range(o.folds) for y in (0, 1))
    if left_out:
        parts = [_tree_scores(booster.fit(rows.where(F.col("fold") != k)), rows.where(F.col("fold") == k)) for k in range(o.folds)]
    else:
        parts = [_tree_scores(trees, rows)]
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    curve = IsotonicRegression(featuresCol="tree_score", labelCol="label", predictionCol="score").fit(scratch.write(scored.select("label", "tree_score"), "scored"))
    scratch.clear()
    return ToxicityModel(lexicons[-1], trees, curve, share)


def _tree_scores(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn("tree_score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row of `docs`."""
    prepare(docs.sparkSession)
    rows = string_columns(docs, "doc_id", "text")
    if model.trees is None or model.curve is None:
        return rows.select("doc_id", F.lit(float(model.share)).alias("score"))
    rows = with_features(rows.withColumn("fold", F.lit(-1)), {-1: model.lexicon}).select("doc_id", array_to_vector("x").alias("features"))
    return model.curve.transform(_tree_scores(model.trees, rows)).select("doc_id", "score")
