"""Quality classification with hierarchical empirical Bayes over sites.

A logistic regression on layout features of the text gives each document a
probability of its own. Grouped sums of these by path and by host, with the
corpus mean above, give every host and path a posterior rate: a beta prior
around the rate one level up, whose strength comes from how much the rates
differ between groups beyond chance, so sparse sites stay near the prior. A
document's evidence (its log odds against the corpus rate) is added to the log
odds of its path's rate, from which its own part has been taken out.

Labels are learned from a bounded sample (see ``toxicity.training_sample``).

Defined results: null and empty texts have all features 0; a null host or path
is a group of its own; with labels of one class only all evidence is that
class's rate, and without labels 0.5; repeated rows each get a score; a group
of any size is summed before the shuffle and never gathered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicohort.llm.common import ready, slices, stash
from epicohort.llm.rules import SYMBOLS, repeated_words, word_code_points
from epicohort.llm.toxicity import training_sample  # noqa: F401

FEATURES = ("log_words", "mean_word", "capitals", "symbols", "exclamations", "bars", "digits", "repeats", "repeated_lines", "stops",
            "distinct_words")
#: Strengths of a prior, in documents, are held between these.
WEAKEST, STRONGEST = 1.0, 1e6
LEAST = 1e-4


def features(text: bytes | None) -> list[float]:
    import math
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = word_code_points(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(text) - len(text.translate(None, b"0123456789"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return [math.log1p(n), chars / n, upper / chars, symbols / chars, text.count(b"!") / n, words.count(b"|") / n, digits / chars,
            repeated_words(words) / n, 1 - len(set(lines)) / len(lines), text.count(b".") / n, len(set(words)) / n]


def _run(texts: pa.Array) -> pa.Array:
    out = []
    for _, part in slices(texts):
        out += map(features, part.cast(pa.binary()).to_pylist())
    return pa.array(out, pa.list_(pa.float64()))


_run.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def logit(p: Column) -> Column:
    held = F.least(F.lit(1 - LEAST), F.greatest(F.lit(LEAST), p))
    return F.log(held / (1 - held))


def _strength(groups: DataFrame, rate: Column) -> float:
    """Method of moments: documents that a prior counts for, from groups with ``n`` rows, ``s`` sum and ``q`` sum of squares
    of the probabilities around the rate one level up."""
    m = groups.where(F.col("n") > 1).select(
        F.col("n").alias("n"), (F.col("s") / F.col("n") - rate).alias("off"),
        ((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("within"))
    r = m.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("off") * F.col("off")).alias("between"),
              F.sum(F.col("n") * F.col("within")).alias("within"), F.count(F.lit(1)).alias("groups"),
              F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r["groups"]:
        return STRONGEST
    within = max(r["within"] / r["n"], 1e-12)
    excess = (r["between"] - r["groups"] * within) / r["n"]
    return min(STRONGEST, max(WEAKEST, within / excess)) if excess > 0 else STRONGEST


def classify(docs: DataFrame, sample: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, doc_score, host_rate, path_rate, score, kept for each row of ``docs``; ``sample`` has _id, _label."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array
    ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
                       F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.arrow_udf(_run, "array<double>")(F.col(text)).alias("_f"))
    rows = stash(rows.withColumn("_vector", array_to_vector("_f")).drop("_f"), "features")
    train = stash(rows.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("_vector", F.col("_label").cast("double").alias("label")), "train")
    classes = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    total = sum(classes.values())
    if len(classes) < 2:
        own = F.lit(float(max(classes, default=0.5)))
        scored = rows.withColumn("p", own)
    else:
        model = LogisticRegression(featuresCol="_vector", labelCol="label", probabilityCol="_p", regParam=1e-4, maxIter=40).fit(train)
        scored = model.transform(rows).withColumn("p", vector_to_array("_p")[1])
    rate = classes.get(1.0, 0) / total if total else 0.5
    scored = stash(scored.select("doc_id", "host", "path", "p"), "scored")
    paths = stash(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = whole["s"] / whole["n"] if whole["n"] else rate
    by_host = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("s") + by_host * mean) / (F.col("n") + by_host)).alias("host_rate"))
    sites = stash(paths.join(hosts, F.col("host") == F.col("_host")).drop("_host"), "sites")
    by_path = _strength(sites, F.col("host_rate"))
    sites = sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "host_rate", "n", "s")
    joined = scored.join(sites, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")))
    others = (F.col("s") - F.col("p") + by_path * F.col("host_rate")) / (F.col("n") - 1 + by_path)
    evidence = logit(F.col("p")) - logit(F.lit(mean))
    score = 1 / (1 + F.exp(-(evidence + logit(others))))
    return joined.select("doc_id", F.col("p").alias("doc_score"), "host_rate", others.alias("path_rate"), score.alias("score"),
                         (score >= 0.5).alias("kept"))
