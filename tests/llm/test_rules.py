import re
from collections import Counter

from epicohort.llm import rules as R

GOOD = "\n".join(" ".join(f"word{i}{j}" for j in range(12)) + "." for i in range(8))


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t", GOOD, GOOD + "\n" + GOOD, GOOD + "\nHome | News | Sport | About\nAll Rights Reserved 2020",
         " ".join(f"W{i}!!" for i in range(90)), "a b c d a b c d", "é ñ \x85 x\x1cy", "x " * 30_000, "\n".join(["same line again"] * 40),
         GOOD + "\n" + "\n".join(f"x{i}%% y{i}$$ z{i}**" for i in range(50)), "no spaces" * 5_000]


def test_base_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, quality_result boolean")
    judged = R.quality_results(docs)
    r = judged.columns[-1]
    assert r == "quality_result_1"
    got = judged.select("doc_id", f"{r}.*").collect()
    assert len(got) == 2 * len(TEXTS)
    for x in got:
        want = brute(TEXTS[x["doc_id"] % len(TEXTS)])
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        assert x["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert [x["doc_id"] for x in got if x["kept"]] == [3, 5, 3 + len(TEXTS), 5 + len(TEXTS)]


def test_lines_that_fail():
    fails = lambda s: R.line_fails(s.encode(), s.encode().split())
    assert fails("Home | News | Sport | About") and fails("A > B > C > D") and fails("Buy now!! Yes!! No??") and fails("see our PRIVACY policy")
    assert fails("ab$$ cd%% ef&&")
    assert not fails("Who is there? It is I, the king.") and not fails("a | b of a long sentence with few bars in it") and not fails("Yes!")


def test_documents_keep_their_columns_and_lose_failing_lines(spark):
    docs = spark.createDataFrame([(1, TEXTS[5], 7), (None, GOOD, 7), (3, None, 7)], "doc_id long, text string, n_chars long")
    kept = R.clean_documents(docs)
    assert kept.columns == docs.columns and kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, GOOD, len(GOOD)), (None, GOOD, len(GOOD))], key=repr)
    assert R.clean_documents(docs.limit(0)).count() == 0
