import random
import zlib

import numpy as np
import pytest

from epicohort.llm import periodic as P


def brute(words):
    """All runs, by trying every period at every place."""
    n, out = len(words), set()
    for q in range(1, n // P.LEAST_POWER + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(P.LEAST_WORDS, P.LEAST_POWER * q):
                if not any((i, j + q - i, p) in out for p in range(1, q)):
                    out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    draw = random.Random(3)
    out = []
    for _ in range(600):
        words = [draw.choice("abc"[:draw.randint(1, 3)]) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 2)):
            part = [draw.choice("abcd") for _ in range(draw.randint(1, 9))]
            at = draw.randint(0, len(words))
            words[at:at] = part * draw.randint(2, 7) + part[:draw.randint(0, len(part) - 1)]
        out.append(words)
    return out


def test_runs_match_brute_force():
    many = texts()
    runs, left = P._judge([" ".join(w).encode() for w in many])
    for words, own, text in zip(many, runs, left):
        assert own == brute(words)
        assert text == collapsed(words, own)


def test_parts_of_one_text_give_the_same(monkeypatch):
    many = [" ".join(w).encode() for w in texts()[:80]]
    whole = P._judge(many)
    for one, runs, left in zip(many, *whole):
        assert P._judge([one]) == ([runs], [left])


@pytest.mark.parametrize("n, period", [(200_000, 1), (200_000, 3), (100_000, 24_999), (100_000, 25_001), (131_072, 4_096)])
def test_very_long_texts(n, period):
    words = [f"w{i % period}" for i in range(n)]
    runs, left = P._judge([" ".join(words).encode()])
    assert runs == [[(0, n, period)] if n >= 4 * period else []]
    assert left[0].count(" ") + 1 == (period if n >= 4 * period else n)


def test_long_text_without_repeats_and_a_fibonacci_word():
    a, b = "a", "ab"
    while len(b) < 20_000:
        a, b = b, b + a
    assert P.runs_of(np.frombuffer(b.encode(), np.uint8).astype(np.int64)) == []
    assert P._judge([" ".join(map(str, range(300_000))).encode()])[0] == [[]]


def test_column_results_with_nulls_repeats_and_taken_names(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a\ta a\na a b"), (4, "a a\ta a\na a b"), (None, "x y x y x y x y"), (5, "é  é  é  é  é  é ")]
    docs = spark.createDataFrame([(*r, "r", "c") for r in rows], "doc_id long, text string, RUNS string, periodic string")
    out = P.find_runs(docs)
    assert out.columns == ["doc_id", "text", "RUNS", "periodic", "runs_1", "collapsed"]
    got = sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs_1"]], r["collapsed"]) for r in out.collect())
    assert got == sorted([(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 6, 1)], "a b"), (4, [(0, 6, 1)], "a b"), (0, [(0, 8, 2)], "x y"),
                          (5, [(0, 6, 1)], "é ")])
    assert P.find_runs(docs.limit(0)).count() == 0


def test_repeat_tail(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(400)] + [(3, None), (None, "a b c"), (8, "  "), (9, "\tlead\x0b trail\n")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _n int")
    got = {}
    for r in P.repeat_tail(docs).collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    changed = 0
    for doc_id, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
            changed += 1
            assert want in got[doc_id]
        else:
            assert text in got[doc_id]
    assert changed > 20
