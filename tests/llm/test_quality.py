import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epicohort.llm import quality as Q
from epicohort.llm.queries import op7_quality


def rows(spark):
    draw = random.Random(9)
    out = []
    for i in range(600):
        bad = draw.random() < (0.8 if i % 3 == 0 else 0.1)
        text = " ".join(draw.choice("one two three four five six".split()) + str(draw.randint(0, 99)) for _ in range(30))
        out.append((i, text.upper().replace(" ", "!! ") if bad and draw.random() < 0.9 else text + ".", f"h{i % 3}", int(not bad)))
    return spark.createDataFrame(out, "doc_id long, text string, host string, quality int")


def test_sites_are_shrunk_as_in_brute_force(spark):
    docs = rows(spark).unionByName(spark.createDataFrame([(900, "plain words.", "lonely", None), (901, None, None, None)],
                                                         "doc_id long, text string, host string, quality int"))
    sample = Q.training_sample(docs, "quality", "doc_id", F.lit(True))
    got = {r["doc_id"]: r for r in Q.classify(docs, sample, F.col("host"), F.lit("p")).collect()}
    assert len(got) == 602 and all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in got.values())
    p = {d: r["doc_score"] for d, r in got.items()}
    host = {r["doc_id"]: r["host"] or "" for r in docs.collect()}
    mean = np.mean(list(p.values()))
    groups = {h: [p[d] for d in p if host[d] == h] for h in set(host.values())}
    big = {h: g for h, g in groups.items() if len(g) > 1}
    n = sum(map(len, big.values()))
    within = sum(len(g) * np.var(g, ddof=1) for g in big.values()) / n
    excess = (sum(len(g) * (np.mean(g) - mean) ** 2 for g in big.values()) - len(big) * within) / n
    strength = min(Q.STRONGEST, max(Q.WEAKEST, within / excess))
    for h, g in groups.items():
        rate = (sum(g) + strength * mean) / (len(g) + strength)
        assert all(got[d]["host_rate"] == pytest.approx(rate, rel=1e-9) for d in p if host[d] == h)
    assert got[0]["host_rate"] < got[1]["host_rate"]


def test_one_class_no_labels_and_no_rows(spark):
    docs = rows(spark).limit(20)
    for part, own in ((docs.where("quality = 1"), 1.0), (docs.limit(0), 0.5)):
        got = Q.classify(docs, Q.training_sample(part, "quality", "doc_id", F.lit(True)), F.col("host"), F.col("host")).collect()
        assert {r["doc_score"] for r in got} == {own} and len(got) == 20
    assert Q.classify(docs.limit(0), Q.training_sample(docs, "quality", "doc_id", F.lit(True)), F.col("host"), F.col("host")).count() == 0


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in op7_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in label]
    assert np.mean([r["kept"] == (label[r["doc_id"]] == 1) for r in got]) > 0.85
