"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned first: words, and word beginnings of 3 to 7 characters,
that stand in far more toxic than other training texts. Each text then gets
dense features: densities and peaks of the lexicon's words and beginnings,
second persons near a lexicon word, capitals, punctuation and obfuscation
rates. Boosted trees are fitted on the training rows' features, and an
isotonic regression turns their scores into probabilities on training rows
that the trees have not seen.

Labels are learned from a bounded sample of the training rows: ``SAMPLE``
documents in expectation, chosen by a hash of the id.

Defined results: null and empty texts have all features 0 and are scored like
any other; rows with a null label are not learned from; several labels of one
id count as their largest; with labels of one class only, every score is that
class, and without labels 0; repeated rows each get a score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicohort.llm.common import Shared, hash_share, ready, slices, stash

#: Labelled documents that are learned from, in expectation.
SAMPLE = 40_000
#: Folds of the sample that calibrate: one in so many.
CALIBRATION_FOLD = 4
#: Entries of the lexicon at most: the strongest of those that qualify.
LEXICON = 4_000
PREFIXES = range(3, 8)
#: An entry stands in this many toxic training texts at least, with a log odds ratio and a root of its
#: likelihood-ratio statistic (against equal shares in both classes) of at least these.
LEAST_TEXTS, LEAST_RATIO, LEAST_Z = 5, 2.0, 4.5
#: Second persons of a few languages.
SECOND_PERSON = frozenset("you your yours yourself u ur ya du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos "
                          "tú ti tuyo usted ustedes vosotros".split())
NEAR = 5
#: Training texts count as near copies from this Jaccard similarity of their three-word shingles.
ALIKE = 0.8
#: Four orders of the shingles' hashes; two texts as alike as that miss each other in all with a chance of 0.2 ** 4.
_ORDERS = [(np.uint64(a), np.uint64(b)) for a, b in ((0, 1), (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9),
                                                   (0xD1B54A32D192ED03, 0x94D049BB133111EB), (0x8CB92BA72F3D8DD7, 0xFF51AFD7ED558CCD))]
#: Signs that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!|", "oleastasil")

FEATURES = ("word_density", "word_peak", "word_kinds", "stem_density", "stem_peak", "stem_kinds", "disguised_density",
            "near_second_person", "second_person_density", "capitals", "capital_words", "exclamations", "questions",
            "other_punctuation", "mixed_words", "stretched_words", "log_words")

_WORDS = re.compile(r"[^\W_]+(?:[@$!*|0-9][^\W_]+)*").findall
_PUNCTUATION = re.compile(r"[^\w\s!?]").findall
_STRETCHED = re.compile(r"(.)\1\1").search
_MIXED = re.compile(r"\d.*[^\W\d_]|[^\W\d_].*\d|[@$!*|]").search


def terms(text: str | None) -> set[str]:
    """What a text counts once towards the lexicon: its words (``=word``) and their beginnings (``^pre``)."""
    words = set(_WORDS(text.lower())) if text else set()
    out = {"=" + w for w in words}
    for n in PREFIXES:
        out.update(["^" + w[:n] for w in words if len(w) > n])
    return out


def term_counts(train: DataFrame, text: str, label: str) -> DataFrame:
    """term, toxic texts, other texts that hold it; each task adds up its own before the shuffle."""
    def run(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for start, part in slices(batch.column("text")):
                for side, body in zip(labels[start:start + len(part)], part.to_pylist()):
                    for term in terms(body):
                        own = counts.get(term)
                        if own is None:
                            own = counts[term] = [0, 0]
                        own[side] += 1
            if len(counts) > 500_000:
                yield from _batch(counts)
                counts = {}
        yield from _batch(counts)

    def _batch(counts):
        keys = list(counts)
        for start, part in slices(keys, 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[k][1] for k in part], pa.int64()),
                                              pa.array([counts[k][0] for k in part], pa.int64())], ["term", "toxic", "other"])
    own = train.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    out = own.mapInArrow(run, "term string, toxic bigint, other bigint")
    return out.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn_lexicon(train: DataFrame, text: str, label: str) -> dict[str, float]:
    """Weights (log odds ratios) of the entries; ``train`` holds each text once. At most LEXICON entries reach the driver."""
    sizes = train.agg(F.sum(F.col(label).cast("long")).alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    toxic, other = sizes["toxic"] or 0, (sizes["n"] or 0) - (sizes["toxic"] or 0)
    ratio = F.log((F.col("toxic") + 0.5) / (toxic + 0.5)) - F.log((F.col("other") + 0.5) / (other + 0.5))
    held, share = F.col("toxic") + F.col("other"), toxic / max(1, toxic + other)
    surprise = lambda n, p: F.when(n > 0, n * F.log(n / (held * p))).otherwise(0.0)
    z = F.sqrt(2 * (surprise(F.col("toxic"), share) + surprise(F.col("other"), 1 - share)))
    found = term_counts(train, text, label).where(F.col("toxic") >= LEAST_TEXTS) \
        .select("term", ratio.alias("ratio"), z.alias("z")) \
        .where((F.col("ratio") >= LEAST_RATIO) & (F.col("z") >= LEAST_Z))
    return {r["term"]: float(r["ratio"]) for r in found.orderBy(F.desc("z"), "term").limit(LEXICON).collect()}


class Featurizer:
    """Dense features of a text under one lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.words = {t[1:]: w for t, w in lexicon.items() if t[0] == "="}
        self.stems = {t[1:]: w for t, w in lexicon.items() if t[0] == "^"}
        self.memo: dict[str, tuple | None] = {}

    def judge(self, word: str) -> tuple[float, float, float] | None:
        """Weights of a lower-cased word as a word, by its beginnings, and without its disguise; None if all are 0."""
        if word in self.memo:
            return self.memo[word]
        stem = max((self.stems.get(word[:n], 0.0) for n in PREFIXES if len(word) > n), default=0.0)
        own, plain = self.words.get(word, 0.0), 0.0
        if not word.isalpha():
            bare = word.translate(DISGUISE)
            plain = self.words.get(bare, 0.0) if bare != word else 0.0
        out = (own, stem, plain) if own or stem or plain else None
        if len(word) <= 40:
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[word] = out
        return out

    def features(self, text: str | None) -> list[float]:
        words = _WORDS(text) if text else []
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        lower = _WORDS(text.lower())
        hits = [(i, h) for i, h in enumerate(map(self.judge, lower)) if h is not None]
        seconds = [i for i, w in enumerate(lower) if w in SECOND_PERSON]
        near = 0
        if seconds and hits:
            places = np.array(seconds)
            for i, _ in hits:
                k = int(np.searchsorted(places, i - NEAR))
                near += k < len(places) and places[k] <= i + NEAR
        own = [(lower[i], h[0]) for i, h in hits if h[0]]
        stem = [(lower[i], h[1]) for i, h in hits if h[1]]
        plain = sum(h[2] for _, h in hits)
        chars = len(text)
        capitals = sum(map(str.isupper, text))
        marked = [w for w in words if not w.isalpha()]
        return [
            sum(w for _, w in own) / n, max((w for _, w in own), default=0.0), float(min(len({w for w, _ in own}), 20)),
            sum(w for _, w in stem) / n, max((w for _, w in stem), default=0.0), float(min(len({w for w, _ in stem}), 20)),
            plain / n, near / n, len(seconds) / n, capitals / chars,
            sum(1 for w in words if len(w) > 1 and w.isupper()) / n if capitals > n // 4 else 0.0,
            text.count("!") / n, text.count("?") / n, len(_PUNCTUATION(text)) / n,
            sum(1 for w in marked if _MIXED(w)) / n, (sum(1 for w in lower if _STRETCHED(w)) / n) if _STRETCHED(text) else 0.0,
            float(np.log1p(n))]


def text_features(text: Column, lexicon: dict[str, float], spark) -> Column:
    """array<double> of FEATURES of a whole text."""
    shared = Shared(spark, lexicon, Featurizer)

    def run(texts: pa.Array) -> pa.Array:
        featurizer, out = shared.get(), []
        for _, part in slices(texts):
            out += map(featurizer.features, part.to_pylist())
        return pa.array(out, pa.list_(pa.float64()))
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<double>")(text)


def training_sample(labels: DataFrame, label: str, doc_id: str, eligible: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, label of about ``sample`` rows of the labels that are eligible, each id once."""
    rows = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & eligible) \
        .groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    n = rows.count()
    return stash(rows.where(hash_share(F.col("_id"), "labelled") < min(1.0, sample / max(1, n))), "sample")


def _shingles(text: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's three-word shingles (of all its words, where there are fewer), sorted."""
    from xxhash import xxh64_digest
    words = (text or b"").lower().split()
    return np.unique(np.frombuffer(b"".join([xxh64_digest(b" ".join(words[i:i + 3])) for i in range(max(1, len(words) - 2))]), np.uint64))


def _sketch(texts: pa.Array) -> pa.Array:
    out = []
    for _, part in slices(texts.cast(pa.binary())):
        for own in map(_shingles, part.to_pylist()):
            out.append({"n": len(own), "least": [int(((own ^ a) * b).min().view(np.int64)) for a, b in _ORDERS]})
    return pa.array(out, pa.struct([("n", pa.int64()), ("least", pa.list_(pa.int64()))]))


def _similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    out = []
    for start, part in slices(left.cast(pa.binary())):
        for a, b in zip(part.to_pylist(), right[start:start + len(part)].cast(pa.binary()).to_pylist()):
            a, b = _shingles(a), _shingles(b)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both / (len(a) + len(b) - both))
    return pa.array(out, pa.float64())


_sketch.__annotations__ = {"texts": pa.Array, "return": pa.Array}
_similarity.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}


def distinct_texts(rows: DataFrame) -> DataFrame:
    """``rows`` (_id, _label, text) without copies: of equal texts with one label the least id stays, and a text goes
    whose three-word shingles are verified to be ALIKE (Jaccard) or more to those of one with its label that stays.

    Candidates are a text and the first of those that share a least shingle with it, in one of several orders of the
    shingles; a shared shingle alone drops nothing.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    own = rows.groupBy("_label", F.sha2(whole, 256).alias("_copy")).agg(F.min("_id").alias("_id"), F.first("text").alias("text"))
    own = own.select("_id", "_label", "text", F.concat("_copy", F.col("_label").cast("string")).alias("_key"),
                     F.arrow_udf(_sketch, "struct<n:bigint,least:array<bigint>>").asNondeterministic()(whole).alias("_s"))
    own = stash(own.select("_id", "_label", "text", "_key", F.col("_s.n").alias("_n"), F.col("_s.least").alias("_least")), "texts")
    keyed = own.select("_key", "_label", "_n", F.posexplode("_least").alias("_no", "_hash"))
    first = keyed.groupBy("_label", "_no", "_hash").agg(F.min(F.struct("_key", "_n")).alias("_first"), F.count(F.lit(1)).alias("_held"))
    first = stash(first.where(F.col("_held") > 1).drop("_held"), "first")
    pairs = keyed.join(first, ["_label", "_no", "_hash"]) \
        .where((F.col("_key") != F.col("_first._key"))
               & (F.least("_n", "_first._n") >= ALIKE * F.greatest("_n", "_first._n")))  # others cannot be alike enough
    pairs = stash(pairs.select("_key", F.col("_first._key").alias("_lead")).distinct(), "pairs")
    texts = own.select("_key", F.coalesce("text", F.lit("")).alias("_text"))
    leads = texts.select(F.col("_key").alias("_lead"), F.col("_text").alias("_other"))
    alike = F.arrow_udf(_similarity, "double")(F.col("_text"), F.col("_other"))
    near = stash(pairs.join(texts, "_key").join(leads, "_lead").where(alike >= ALIKE).select("_key", "_lead"), "near")
    followers = near.select(F.col("_key").alias("_lead")).distinct()
    gone = near.join(followers, "_lead", "left_anti").select("_key").distinct()  # what it is alike to stays
    return own.join(gone, "_key", "left_anti").select("_id", "_label", "text")


class Toxicity:
    """A fitted model: lexicon, trees and calibration (or a constant score where there was nothing to tell apart)."""

    def __init__(self, lexicon=None, trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon or {}, trees, calibration, constant

    def score(self, rows: DataFrame, features: str) -> DataFrame:
        """``rows`` with a column ``score``; ``features`` names an array<double>."""
        from pyspark.ml.functions import array_to_vector, vector_to_array
        if self.trees is None:
            return rows.withColumn("score", F.lit(float(self.constant)))
        out = self.trees.transform(rows.withColumn("_vector", array_to_vector(features)))
        out = out.withColumn("_raw", F.round(vector_to_array("_p")[1], 4))
        out = self.calibration.transform(out)
        return out.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "_score"))) \
            .drop("_vector", "_raw", "_p", "_rawp", "_predicted", "_score")


def learn(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Toxicity:
    """Fit on the documents of ``sample`` (doc_id, label; bounded, see ``training_sample``)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression
    spark = docs.sparkSession
    ready(spark)
    own = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text"))
    train = own.join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    train = stash(train.select("_id", "_label", "text"), "train")
    train = stash(distinct_texts(train), "distinct")
    classes = {r[0]: r[1] for r in train.groupBy("_label").count().collect()}
    if len(classes) < 2:
        return Toxicity(constant=float(max(classes, default=0) > 0))
    fold = hash_share(F.col("_id"), "calibration") < 1 / CALIBRATION_FOLD
    lexicon = learn_lexicon(train.where(~fold), "text", "_label")
    rows = train.select("_id", F.col("_label").cast("double").alias("label"), text_features(F.col("text"), lexicon, spark).alias("_f"))
    rows = stash(rows.withColumn("_vector", array_to_vector("_f")).drop("_f"), "features")
    fitted, checked = rows.where(~fold), rows.where(fold)
    both = {r[0] for r in fitted.select("label").distinct().collect()}
    if len(both) < 2:
        return Toxicity(lexicon, constant=classes.get(1, 0) / sum(classes.values()))
    trees = GBTClassifier(featuresCol="_vector", labelCol="label", predictionCol="_predicted", maxIter=15, maxDepth=3,
                          stepSize=0.3, seed=7)
    trees = trees.setProbabilityCol("_p").setRawPredictionCol("_rawp").fit(fitted)
    seen = trees.transform(checked).select("label", F.round(vector_to_array("_p")[1], 4).alias("_raw"))
    points = seen.groupBy("_raw").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    if not points.limit(1).count():
        points = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 1.0, 1.0)], "_raw double, label double, weight double")
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="label", weightCol="weight", predictionCol="_score").fit(points)
    return Toxicity(lexicon, trees, calibration)


def score_documents(docs: DataFrame, model: Toxicity, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted for each row of ``docs``."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    rows = own.select("doc_id", text_features(F.col("_text"), model.lexicon, docs.sparkSession).alias("_f")) \
        if model.trees is not None else own.select("doc_id", F.array().cast("array<double>").alias("_f"))
    return model.score(rows, "_f").select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
