import random
import re

from xxhash import xxh64_intdigest

from epicohort.llm import simhash as S
from epicohort.llm.components import connected_components


def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, bits):
    ids, fps, name = [r[0] for r in rows], [r[1] for r in rows], list(range(len(rows)))

    def find(i):
        while name[i] != i:
            i = name[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                name[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(rows))]


def texts():
    draw = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    base = [" ".join(draw.choices(words, k=n)) for n in (1, 2, 3, 4, 30, 200, 400)]
    out = [None, "", " \t\n", "Ärger ÄRGER a\x00b", "A B c", "a b C", *base]
    for t in base[-2:]:
        for _ in range(25):
            own = t.split()
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = draw.choice(words)
            out.append("  ".join(own))
    return out + out[:8]


def test_query_form_matches_brute_force(spark):
    rows = [(i, t, "c") for i, t in enumerate(texts())] + [(3, "again", "c"), (3, "again", "c"), (None, "", "c"), (None, "nobody else says", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = S.near_duplicates(docs, 3, 2).select("doc_id", S.as_hex(S.F.col("fp")).alias("h"), "component_id").collect()
    fps = [(i, brute_fingerprint(t, 3)) for i, t, _ in rows]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(fps, brute_components(fps, 2))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert S.near_duplicates(docs.limit(0), 3, 2).count() == 0


def test_crowded_keys_connect_the_same_fingerprints(spark, monkeypatch):
    draw = random.Random(11)
    centres = [draw.getrandbits(64) for _ in range(3)]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(80):
            x = c
            for _ in range(draw.randint(1, 5)):
                x ^= 1 << draw.randrange(64)
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute_components([(f, f) for f in fps], 2)
    groups = {}
    for f, c in zip(fps, want):
        groups.setdefault(c, set()).add(f - (1 << 64) if f >> 63 else f)
    whole = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    for bound in (256, 2):
        monkeypatch.setattr(S, "PAIRED", bound)
        found = {}
        for r in connected_components(S.near_links(table, 2)).collect():
            found.setdefault(r["root"], set()).add(r["node"])
        assert sorted(sorted(g) for g in found.values()) == whole


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (100, 101)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_one_row_of_each_group_stays(spark):
    rows = [(5, "same text here"), (2, "Same text here"), (2, "same text here"), (9, "other words entirely"), (None, "same text here"),
            (None, "only nameless ones"), (None, "only nameless ones"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = S.keep_one(docs, 3, 2).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == [2, 7, 9, None]
    assert S.keep_one(docs.limit(0), 3, 2).count() == 0


def test_repeated_ids_lose_no_text_and_nameless_near_copies_go(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "entirely different words"), (3, "entirely different words"),
            (2, "some other text again"), (4, "one more of them here"), (4, "some other text again"),
            (None, "only nameless ones"), (None, "Only  nameless ones"), (None, "only nameless ones"), (None, "another nameless text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"].lower().split()) for r in S.keep_one(docs, 3, 2).collect()]
    want = [(1, "alpha beta gamma delta"), (1, "entirely different words"), (2, "some other text again"),
            (4, "one more of them here"), (None, "only nameless ones"), (None, "another nameless text")]
    assert sorted(kept, key=repr) == sorted([(i, t.split()) for i, t in want], key=repr)
