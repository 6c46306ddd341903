import math
import zlib
from collections import Counter

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from epicohort.llm import sharding as S
from epicohort.llm.queries import op10_sharding


def uniform(text):
    return ((xxh64_intdigest(text.encode(), 42) >> 11) + 0.5) / (1 << 53)


def brute(key, weights):
    key, size, found = "null" if key is None else str(key), S.RACKS * S.PLACES, []
    for region in range(math.ceil(len(weights) / size)):
        own = weights[region * size:(region + 1) * size]
        time = 0.0
        for k in range(1 if len(own) == size and min(own) == 1 else S.DRAWS):
            u = lambda level: uniform(f"{key}/{level}{region}/{k}")  # noqa: B023, E731
            time -= math.log(u("region")) / size
            place = math.floor(u("rack") * S.RACKS) * S.PLACES + math.floor(u("shard") * S.PLACES)
            if place < len(own) and u("weight") < own[place]:
                found.append((time, region * size + place))
                break
    return min(found)[1]


def shards(spark, n, weights):
    ids = spark.range(n).select(F.col("id").alias("doc_id"))
    return {r[0]: r[1] for r in ids.select("doc_id", S.choose_shard(F.col("doc_id"), weights)).collect()}


def test_brute_force(spark):
    for weights in ([1.0] * 40, [1.0], [0.5, 1.0, 0.25] * 7):
        assert shards(spark, 300, weights) == {i: brute(i, weights) for i in range(300)}


def test_growth_moves_rows_only_into_the_new_shard(spark):
    was = shards(spark, 3000, [1.0])
    for n in (2, 3, 5, 16, 17, 18, 33):
        before, after = shards(spark, 3000, [1.0] * (n - 1)), shards(spark, 3000, [1.0] * n)
        moved = [i for i in before if before[i] != after[i]]
        assert all(after[i] == n - 1 for i in moved) and abs(len(moved) - 3000 / n) < 5 * math.sqrt(3000 / n)
    assert set(was.values()) == {0}


def test_weights_give_shares_and_confine_movement(spark):
    light = [1.0] * 10 + [0.5] * 10
    heavy = [*light]
    heavy[12] = 1.0
    before, after = shards(spark, 6000, light), shards(spark, 6000, heavy)
    share = Counter(before.values())
    assert abs(sum(share[i] for i in range(10)) / 6000 - 2 / 3) < 0.03
    assert {after[i] for i in before if before[i] != after[i]} == {12}


def test_last_resort_without_a_standing_draw(spark, monkeypatch):
    monkeypatch.setattr(S, "DRAWS", 1)
    a, b = shards(spark, 2000, [1.0] * 3), shards(spark, 2000, [1.0] * 4)
    assert set(a.values()) == {0, 1, 2} and all(b[i] == 3 for i in a if a[i] != b[i])


def test_slots_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 3)
    rows = [(i, f"text {i % 5}", 1) for i in range(200)] + [(7, "same", 1)] * 50 + [(None, None, 1), (None, "é", 1), (8, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    got = S.number_slots(S.assign_shards(docs, [1.0] * 4, [1.0] * 5)).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == \
        sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows if i is not None)
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert S.number_slots(S.assign_shards(docs.limit(0), [1.0])).count() == 0


def test_query(spark):
    rows = op10_sharding(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and {r["law"] for r in rows} == {"key"}
    assert all(r["shard"] == brute(r["doc_id"], [1.0] * 40) and r["grown_shard"] in (r["shard"], 40) for r in rows)
