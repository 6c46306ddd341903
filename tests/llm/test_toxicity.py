import random

import numpy as np
from pyspark.sql import functions as F

from epicohort.llm import toxicity as T
from epicohort.llm.queries import op6_toxicity


def test_features_of_one_text():
    f = T.Featurizer({"=rotter": 3.0, "^grum": 2.0})
    x = dict(zip(T.FEATURES, f.features("You ROTTER! grumblewort r0tter sooo fine, calm words here")))
    assert x["word_kinds"] == 1 and x["stem_kinds"] == 1 and x["word_peak"] == 3.0 and x["stem_peak"] == 2.0
    assert x["disguised_density"] > 0 and x["near_second_person"] > 0 and x["stretched_words"] > 0 and x["mixed_words"] > 0
    assert f.features(None) == f.features("") == f.features("...") == [0.0] * len(T.FEATURES)
    assert f.features("you " * 50_000)[T.FEATURES.index("second_person_density")] == 1.0


def planted(spark, n=400):
    draw = random.Random(4)
    rows = []
    for i in range(n):
        words = [f"w{draw.randint(0, 400)}" for _ in range(40)]
        if i % 4 == 0:
            words[draw.randrange(40)] = "rotter"
        rows.append((i, " ".join(words) + f" {i}", int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_learned_lexicon_scores_and_edge_cases(spark):
    docs = planted(spark)
    extra = spark.createDataFrame([(1000, None, None), (1001, "", None), (None, "rotter", None), (0, "rotter twice", None)], "doc_id long, text string, toxic int")
    docs = docs.unionByName(extra)
    sample = T.training_sample(docs, "toxic", "doc_id", F.col("doc_id") < 300)
    assert sample.count() == 300
    m = T.learn(docs, sample)
    assert "=rotter" in m.lexicon
    rows = T.score_documents(docs, m).collect()
    assert len(rows) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    late = [r for r in rows if r["doc_id"] is not None and 300 <= r["doc_id"] < 400]
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in late)


def test_one_class_and_no_labels(spark):
    docs = planted(spark, 40)
    for rows, score in ((docs.where("toxic = 1"), 1.0), (docs.where("toxic = 0"), 0.0), (docs.limit(0), 0.0)):
        m = T.learn(docs, T.training_sample(rows, "toxic", "doc_id", F.lit(True)))
        assert {r["score"] for r in T.score_documents(docs, m).collect()} == {score}
    assert T.score_documents(docs.limit(0), m).count() == 0


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op6_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in label]
    toxic = np.array([label[r["doc_id"]] for r in rows]) == 1
    found = np.array([r["predicted"] for r in rows]) == 1
    assert toxic.sum() > 40 and (found & toxic).sum() / toxic.sum() > 0.9 and (found & ~toxic).sum() / (~toxic).sum() < 0.01


def lorem(n):
    """Different texts of a small vocabulary, a quarter with the one word that tells."""
    draw, rows = random.Random(4), []
    for i in range(n):
        words = [draw.choice("lorem ipsum dolor sit amet sed magna".split()) for _ in range(40)]
        if i % 4 == 0:
            words[draw.randrange(40)] = "rotter"
        rows.append((i, int(i % 4 == 0), " ".join(words) + f" {i}"))
    return rows


def test_only_true_copies_count_once(spark):
    schema = "_id long, _label int, text string"
    draw = random.Random(5)
    word = lambda: f"v{draw.randint(0, 10**6)}"
    passage = " ".join(word() for _ in range(100))
    shared = [(1000 + i, 0, passage + " " + " ".join(word() for _ in range(100))) for i in range(200)]
    base = [word() for _ in range(300)]
    near = [(2000 + i, 0, " ".join(base[:10 * i] + [f"x{i}"] + base[10 * i + 1:])) for i in range(20)]
    exact = [(3000, 0, "the same"), (3001, 0, "the same"), (3002, 1, "the same"), (3003, 0, None), (3004, 0, "")]
    small = lorem(300)
    left = [r["_id"] for r in T.distinct_texts(spark.createDataFrame(small + shared + near + exact, schema)).collect()]
    assert len(left) == len(set(left))
    assert {i for i in left if i < 2000} == {r[0] for r in small + shared}
    assert len([i for i in left if 2000 <= i < 3000]) == 1
    assert {i for i in left if i >= 3000} == {3000, 3002, 3003}


def test_texts_that_share_a_passage_are_all_learned_from(spark):
    draw = random.Random(6)
    word = lambda: f"v{draw.randint(0, 10**6)}"
    passage = " ".join(word() for _ in range(140))
    rows = [(i, int(i % 4 == 0), " ".join([passage, *[word() for _ in range(40)], "rotter" if i % 4 == 0 else "calm"])) for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    m = T.learn(docs, T.training_sample(docs, "toxic", "doc_id", F.lit(True)))
    assert "=rotter" in m.lexicon


def plain_features(text, lexicon):
    """The features by their definitions, one loop for each."""
    import re
    words = re.findall(r"[^\W_]+(?:[@$!*|0-9][^\W_]+)*", text or "")
    n = len(words)
    if not n:
        return [0.0] * len(T.FEATURES)
    lower = re.findall(r"[^\W_]+(?:[@$!*|0-9][^\W_]+)*", text.lower())
    signs = dict(zip("013457@$!|", "oleastasil"))
    word_w, stem_w, plain_w = [], [], []
    for w in lower:
        word_w.append(lexicon.get("=" + w, 0.0))
        stem_w.append(max([lexicon.get("^" + w[:k], 0.0) for k in range(3, 8) if k < len(w)] + [0.0]))
        bare = "".join(signs.get(c, c) for c in w)
        plain_w.append(lexicon.get("=" + bare, 0.0) if not w.isalpha() and bare != w else 0.0)
    hit = [i for i in range(len(lower)) if word_w[i] or stem_w[i] or plain_w[i]]
    second = [w in T.SECOND_PERSON for w in lower]
    capitals = sum(c.isupper() for c in text)
    stretched = any(text[i] == text[i + 1] == text[i + 2] != "\n" for i in range(len(text) - 2))
    mixed = lambda w: bool(re.search(r"\d.*[^\W\d_]|[^\W\d_].*\d|[@$!*|]", w))
    return [sum(word_w) / n, max(word_w), float(min(20, len({w for w, x in zip(lower, word_w) if x}))),
            sum(stem_w) / n, max(stem_w), float(min(20, len({w for w, x in zip(lower, stem_w) if x}))), sum(plain_w) / n,
            sum(any(second[max(0, i - 5):i + 6]) for i in hit) / n, sum(second) / n, capitals / len(text),
            sum(len(w) > 1 and w.isupper() for w in words) / n if capitals > n // 4 else 0.0, text.count("!") / n, text.count("?") / n,
            sum(bool(re.match(r"[^\w\s!?]", c)) for c in text) / n, sum(not w.isalpha() and mixed(w) for w in words) / n,
            sum(any(w[i] == w[i + 1] == w[i + 2] for i in range(len(w) - 2)) for w in lower) / n if stretched else 0.0, float(np.log1p(n))]


def tree_value(lines, x):
    """The prediction of a tree, read from its printed form."""
    import re
    depth = lambda line: len(line) - len(line.lstrip())
    i = 0
    while True:
        rule = lines[i].strip()
        if rule.startswith("Predict:"):
            return float(rule.split(":")[1])
        feature, sign, bound = re.match(r"If \(feature (\d+) (<=|>) (\S+)\)", rule).groups()
        if (x[int(feature)] <= float(bound)) == (sign == "<="):
            i += 1
        else:
            i = next(j for j in range(i + 1, len(lines)) if depth(lines[j]) == depth(lines[i]) and lines[j].strip().startswith("Else")) + 1


def test_scores_match_plain_features_tree_sums_and_pooled_violators(spark):
    draw = random.Random(9)
    docs = planted(spark)
    model = T.learn(docs, T.training_sample(docs, "toxic", "doc_id", F.col("doc_id") < 300))
    texts = ["You ROTTER!", "r0tter rotterly you", "calm words", "", None, "SHOUT OUT loud???", "soooo w1 @nd", "rotter"] + [
        " ".join(draw.choice(["rotter", "you", "W7", "r0tt3r", "fine!", "a1b", "(so)", "yesss"]) for _ in range(draw.randint(1, 30))) for _ in range(60)]
    featurizer = T.Featurizer(model.lexicon)
    for t in texts:
        assert np.allclose(featurizer.features(t), plain_features(t, model.lexicon), atol=1e-12)
    rows = T.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    trees = [(w, [line for line in t.toDebugString.splitlines()[1:] if line.strip()]) for w, t in zip(model.trees.treeWeights, model.trees.trees)]
    bounds, values = np.array(model.calibration.boundaries.toArray()), np.array(model.calibration.predictions.toArray())
    for r in rows:
        x = plain_features(texts[r["doc_id"]], model.lexicon)
        raw = 1 / (1 + np.exp(-2 * sum(w * tree_value(lines, x) for w, lines in trees)))
        want = float(np.interp(round(raw, 4), bounds, values))
        assert abs(r["score"] - min(1.0, max(0.0, want))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5)


def test_calibration_pools_adjacent_violators(spark):
    from pyspark.ml.regression import IsotonicRegression
    draw = random.Random(3)
    points = sorted({round(draw.random(), 2): (draw.random(), float(draw.randint(1, 9))) for _ in range(60)}.items())
    blocks = []
    for x, (y, w) in points:
        blocks.append([y * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            total, weight, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + weight, blocks[-1][2] + n]
    want = [total / weight for total, weight, n in blocks for _ in range(n)]
    df = spark.createDataFrame([(x, y, w) for x, (y, w) in points], "_raw double, label double, weight double")
    fitted = IsotonicRegression(featuresCol="_raw", labelCol="label", weightCol="weight", predictionCol="_score").fit(df)
    got = [r["_score"] for r in fitted.transform(df).orderBy("_raw").collect()]
    assert np.allclose(got, want)
