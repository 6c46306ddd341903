import random

import numpy as np

from epicohort.llm import decontaminate as D
from epicohort.llm.tiling import greedy_tiles


def brute_tiles(pattern, text, least):
    done_p, done_t, out = [False] * len(pattern), [False] * len(text), []
    while True:
        best, where = least - 1, None
        for j in range(len(text)):
            for i in range(len(pattern)):
                k = 0
                while i + k < len(pattern) and j + k < len(text) and pattern[i + k] == text[j + k] > 0 \
                        and not done_p[i + k] and not done_t[j + k]:
                    k += 1
                if k > best:
                    best, where = k, (i, j)
        if where is None:
            return sorted(out)
        i, j = where
        for k in range(best):
            done_p[i + k] = done_t[j + k] = True
        out.append((i, j, best))


def test_tiles_match_brute_force():
    draw = random.Random(3)
    for _ in range(300):
        n, m, letters, least = draw.randint(1, 25), draw.randint(1, 40), draw.choice([2, 3, 8]), draw.choice([1, 2, 3, 5])
        pattern, text = [draw.randint(1, letters) for _ in range(n)], [draw.randint(0, letters) for _ in range(m)]
        if n < m and draw.random() < 0.5:
            text[:n] = pattern
        got = greedy_tiles(np.array(pattern), np.array(text), least)
        assert sorted(k for *_, k in got) == sorted(k for *_, k in brute_tiles(pattern, text, least))
        assert all(pattern[i:i + k] == text[j:j + k] for i, j, k in got)


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def frames(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_whole_reordered_partial_and_clean_passages(spark):
    words = ITEM.split()
    reordered = " ".join(words[8:] + ["and"] + words[:8])
    half = " ".join(words[:7])
    docs, items = frames(spark, [f"before {ITEM.upper()}, after", reordered, half, "nothing of that kind at all here", None, "", ITEM, ITEM],
                         [ITEM, None, "", "too short an item"])
    rows = {(r["doc_id"], r["item_id"]): r for r in D.leaks(docs, items).collect()}
    assert set(rows) == {(0, 0), (1, 0), (6, 0), (7, 0)}
    assert rows[0, 0]["coverage"] == 1.0 and [tuple(t) for t in rows[0, 0]["tiles"]] == [(0, 1, 16)]
    assert [tuple(t) for t in rows[1, 0]["tiles"]] == [(0, 9, 8), (8, 0, 8)]
    clash = docs.selectExpr("doc_id", "text", "'x' AS leaks", "1 AS coverage")
    kept = D.decontaminate(clash, items)
    assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5]
    assert D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0


def test_short_items_and_unspaced_scripts(spark):
    chinese, thai = "水的沸点在海平面上是一百度", "น้ำเดือดที่อุณหภูมิหนึ่งร้อยองศา"
    docs, items = frames(spark, ["who wrote The Iliad? the iliad", "the Iliad who wrote", f"我们知道{chinese}吗", f"รู้ไหมว่า{thai}ครับ", "水的颜色", "yes, iliad"],
                         ["the iliad", chinese, thai, "who wrote the iliad", "Iliad", "Iliad", "..."])
    rows = {(r["doc_id"], r["item_id"]): r for r in D.leaks(docs, items).collect()}
    assert set(rows) == {(0, 0), (0, 3), (0, 4), (0, 5), (1, 0), (1, 4), (1, 5), (2, 1), (3, 2), (5, 4), (5, 5)}
    assert all(r["coverage"] == 1.0 and r["covered_words"] == r["item_words"] for r in rows.values())
    assert [tuple(t) for t in rows[0, 0]["tiles"]] == [(0, 2, 2)] and [tuple(t) for t in rows[0, 3]["tiles"]] == [(0, 0, 4)]
    assert rows[2, 1]["item_words"] == 13
    assert [r["doc_id"] for r in D.decontaminate(docs, items).collect()] == [4]


def test_blocks_of_items_give_the_same_rows(spark, monkeypatch):
    draw = random.Random(5)
    items = [" ".join(draw.choice("abcdefghij") + str(draw.randint(0, 9)) for _ in range(20)) for _ in range(12)]
    texts = [" ".join(["x"] * 3 + [draw.choice(items), "y", draw.choice(items)]) for _ in range(30)]
    docs, bench = frames(spark, texts, items)
    key = lambda rows: sorted((r["doc_id"], r["item_id"], r["covered_words"]) for r in rows)
    whole = key(D.leaks(docs, bench).collect())
    monkeypatch.setattr(D, "BLOCK_WORDS", 50)
    assert key(D.leaks(docs, bench).collect()) == whole and len(whole) >= 30


def test_blocks_hold_so_many_words_in_any_script(spark, monkeypatch):
    draw = random.Random(6)
    cyrillic = [" ".join("".join(draw.choice("абвгдежзик") for _ in range(6)) for _ in range(20)) for _ in range(12)]
    docs, bench = frames(spark, cyrillic, cyrillic)
    copies = bench.where("item_id = 0")
    bench = bench.unionByName(copies).unionByName(copies)
    monkeypatch.setattr(D, "BLOCK_WORDS", 50)
    blocks = [shared.value.value for shared in D._blocks(bench, "item_id", "text", 5, 0.5)]
    assert all(sum(len(D._WORDS(item[1])) for item in block) <= 50 for block in blocks) and len(blocks) == 6
    found = sorted((r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench).collect())
    assert found == sorted([(i, i) for i in range(12)] + [(0, 0)] * 2)


def test_query_matches_brute_force(spark):
    from epicohort.llm.queries import op2_decontaminate
    sf = "/root/testdata/sf0.001"
    number = {}
    as_ids = lambda t: [number.setdefault(w, len(number) + 1) for w in D._WORDS((t or "").lower())]
    docs = [(r["doc_id"], as_ids(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], as_ids(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = set()
    for i, item in items:
        seeds = {tuple(item[k:k + 5]) for k in range(len(item) - 4)}
        for d, text in docs:
            near = {p for k in range(len(text) - 4) if tuple(text[k:k + 5]) in seeds for p in range(k, k + 5)}
            if near:
                cut = [w if k in near else 0 for k, w in enumerate(text)]
                covered = sum(k for *_, k in brute_tiles(item, [w for k, w in enumerate(cut) if w or (k and cut[k - 1])], 5))
                if covered >= 0.5 * len(item):
                    want.add((d, i, covered))
    assert {(r["doc_id"], r["item_id"], r["covered_words"]) for r in op2_decontaminate(spark, sf).collect()} == want
