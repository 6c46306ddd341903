import numpy as np
from pyspark.sql import functions as F

from epicohort.llm import langid as G
from epicohort.llm.queries import op4_language_id

A, B = "alpha banana cabana salad panama " * 8, "xylo wyrm zykly gryph fjord " * 8


def model(spark):
    docs = spark.createDataFrame([(i, A if i % 2 else B, "a" if i % 2 else "x") for i in range(20)] + [(50, None, "a"), (51, "q", None)],
                                 "doc_id long, text string, lang string")
    return G.learn(docs)


def test_trigrams_stay_inside_their_text():
    b, s = G.trigrams(["ab cd", "", "x", "a!!b  c", None, "AB\0cd", "12 34"])
    assert s.tolist() == [0, 4, 4, 5, 8, 8, 12, 12]
    assert (b[s[0]:s[1]] == b[s[5]:s[6]]).all()


def test_mixture_proportions_and_edge_cases(spark):
    m = model(spark)
    texts = [A, B, A + A + A + B, None, "", "123 !?", "banana"] + [A * 300]
    got = m.mixtures(texts)
    assert [x[0] for x in got] == ["a", "x", "a", "und", "und", "und", "a", "a"]
    assert got[0][1] > 0.99 and 0.65 < got[2][1] < 0.85 and got[3][1] == got[5][1] == 0.0
    assert G.Languages([], np.zeros((0, G.BUCKETS))).mixtures(["text"]) == [("und", 0.0)]


def test_filter_keeps_columns_and_repeats(spark):
    docs = spark.createDataFrame([(1, A, "p"), (1, A, "p"), (2, None, "q"), (None, "99", "r")], "doc_id long, text string, language string")
    kept = G.keep_identified(docs, model(spark))
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1, 1]
    assert G.keep_identified(docs.limit(0), model(spark)).count() == 0
    assert G.learn(docs.limit(0).selectExpr("*", "language AS lang")).names == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_language_id(spark, sf).collect()
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert len(rows) == len(lang) and len(held) > 150
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def overlapping(n_langs):
    """A model of languages that share half their words, and a text generator."""
    draw = np.random.default_rng(3)
    word = lambda: "".join(draw.choice(list("abcdefghijklmnop"), draw.integers(3, 8)))
    common = [word() for _ in range(60)]
    words = [[*draw.choice(common, 30), *[word() for _ in range(30)]] for _ in range(n_langs)]

    def text(lang, letters):
        out = ""
        while len(out) < letters:
            out += draw.choice(words[lang]) + " "
        return out
    buckets = [G.trigrams([text(k, 30_000)])[0] for k in range(n_langs)]
    return G.Languages([f"l{k:02}" for k in range(n_langs)], np.array([np.bincount(b, minlength=G.BUCKETS) for b in buckets])), text


def test_a_second_language_stays_however_many_are_learned(spark):
    m, text = overlapping(30)
    mixed = m.mixtures([text(k, 240) + text((k + 7) % 30, 60) for k in range(30)])
    assert [x[0] for x in mixed] == m.names and sum(0.5 < x[1] < 0.9 for x in mixed) >= 27
    pure = m.mixtures([text(k, 300) for k in range(30)])
    assert [x[0] for x in pure] == m.names and sum(x[1] > 0.95 for x in pure) >= 27


def test_fits_settle_and_the_chosen_set_is_a_result(spark):
    m, text = overlapping(6)
    texts = [text(2, 700) + text(4, 300), text(1, 500), "", text(0, 400) + text(3, 350) + text(5, 300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = [r["p"] for r in rows.select("i", G.predict(F.col("text"), m, spark).alias("p")).orderBy("i").collect()]
    assert [set(r["languages"]) for r in got] == [{"l02", "l04"}, {"l01"}, set(), {"l00", "l03", "l05"}]
    for text, r in zip(texts, got):
        if r["languages"]:
            assert abs(sum(r["proportions"]) - 1) < 1e-9 and r["lang_pred"] == r["languages"][0] and r["score"] == r["proportions"][0] == max(r["proportions"])
            own = np.bincount(G.trigrams([text])[0], minlength=G.BUCKETS)
            chance = m.chance[[m.names.index(x) for x in r["languages"]]]
            slope = (chance * own / (np.array(r["proportions"]) @ chance)).sum(axis=1)
            assert slope.max() - own.sum() <= 3 * G.SETTLED + 1e-6
    assert got[2]["lang_pred"] == "und" and got[2]["proportions"] == []


def plain_em(chance, n, members):
    """Proportions and log-likelihood of a mixture of some languages, by many plain steps."""
    p = {j: 1 / len(members) for j in members}
    for _ in range(4_000):
        new = dict.fromkeys(members, 0.0)
        for t, count in enumerate(n):
            total = sum(p[j] * chance[j][t] for j in members)
            for j in members:
                new[j] += count * p[j] * chance[j][t] / total
        whole = sum(new.values())
        moved = max(abs(new[j] / whole - p[j]) for j in members)
        p = {j: new[j] / whole for j in members}
        if moved < 1e-9:
            break
    return p, sum(c * np.log(sum(p[j] * chance[j][t] for j in members)) for t, c in enumerate(n))


def test_compositions_match_plain_em_over_all_sets_of_languages():
    """Mixtures of one to three of four languages that share half of their syllables: the chosen set has the
    greatest penalised likelihood of all sets, and its proportions are those of plain expectation-maximisation."""
    from itertools import combinations
    draw = np.random.default_rng(2)
    common = ["ba", "do", "mi", "re"]
    own = [common + s for s in (["ka", "xo", "zu"], ["lef", "nig", "pum"], ["thr", "ost", "eik"], ["qua", "vii", "woy"])]
    word = lambda lang: "".join(draw.choice(own[lang], 3))
    training = [" ".join(word(lang) for _ in range(4_000)) for lang in range(4)]
    buckets, starts = G.trigrams(training)
    counts = np.array([np.bincount(buckets[starts[k]:starts[k + 1]], minlength=G.BUCKETS) for k in range(4)], float)
    model = G.Languages(list("abcd"), counts)
    texts = [" ".join(word(lang) for lang in draw.choice(mix, 50)) for mix in ([0], [3], [0, 1], [2, 3], [1, 2], [0, 1, 2], [0, 0, 0, 3]) for _ in range(2)]
    for text, found in zip(texts, model.compositions(texts)):
        b, _ = G.trigrams([text])
        at, n = np.unique(b, return_counts=True)
        chance = model.chance[:, at]
        penalty = 0.5 * np.log(max(n.sum() / 3, 2))
        fits = {m: plain_em(chance, n, m) for size in range(1, 5) for m in combinations(range(4), size)}
        best = max(fits, key=lambda m: fits[m][1] / 3 - penalty * len(m))
        assert {name for name, _ in found} == {"abcd"[j] for j in best}
        for name, share in found:
            assert abs(share - fits[best][0]["abcd".index(name)]) < 0.02


def test_memory_is_bounded_by_bytes_and_languages():
    """A long text among others and forty languages: the slices of a batch hold few trigrams each."""
    import pyarrow as pa

    from epicohort.llm.common import slices
    texts = pa.array(["short text"] * 50 + ["long text " * 200_000] + ["short text"] * 50)
    sizes = [sum(len(t) for t in part.to_pylist()) for _, part in slices(texts, most=G.SLICE_TRIGRAMS // 40)]
    assert sum(sizes) == sum(map(len, texts.to_pylist())) and sorted(sizes)[-2] <= G.SLICE_TRIGRAMS // 40
    draw = np.random.default_rng(1)
    model = G.Languages([f"l{i}" for i in range(40)], draw.integers(0, 9, (40, G.BUCKETS)).astype(float))
    some = ["alpha beta gamma delta", "x" * 3_000, "", None, "one two three " * 60]
    assert model.compositions(some) == [model.compositions([t])[0] for t in some]
