"""Gapless numbers, hot keys and NULL keys."""
from pyspark.sql import functions as F

from epicohort.operators import numbering as N


def test_dense_id_is_gapless_with_a_hot_key_and_nulls(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 97:03d}", i) for i in range(700)] + [(None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "person string, ID long")
    got = N.dense_id(df, "person", "n").collect()
    assert sorted((r["person"] or "", r["ID"]) for r in got) == sorted((p or "", i) for p, i in rows)
    number = {}
    for r in got:
        assert number.setdefault(r["person"], r["n"]) == r["n"]
    order = sorted(k for k in number if k is not None) + [None]
    assert [number[k] for k in order] == list(range(1, len(order) + 1))


def test_dense_id_of_an_empty_table(spark):
    assert N.dense_id(spark.createDataFrame([], "person string"), "person").columns == ["person", "id"]
    assert N.dense_id(spark.createDataFrame([], "person string"), "person").count() == 0


def test_number_within_orders_each_group(spark):
    rows = [(k, i * 7 % 31, "x") for k in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, v long, _at string")
    got = {}
    for r in N.number_within(df, "k", [F.col("v")], "pos").collect():
        got.setdefault(r["k"], []).append((r["pos"], r["v"]))
    assert set(got) == {"a", "b", None}
    for found in got.values():
        found.sort()
        assert [p for p, _ in found] == list(range(60))
        assert [v for _, v in found] == sorted(i * 7 % 31 for i in range(60))


def test_lookup_join_answers_hot_keys_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT_KEYS", 4)
    rows = spark.createDataFrame([("hot", i) for i in range(90)] + [("b", 1), ("c", 2), (None, 3)], "k string, i long")
    table = spark.createDataFrame([("hot", 1.0), ("b", 2.0)], "k string, v double")
    got = sorted(((r["k"] or "", r["i"], r["v"]) for r in N.lookup_join(rows, table, "k").collect()))
    assert got == sorted([("hot", i, 1.0) for i in range(90)] + [("b", 1, 2.0), ("c", 2, None), ("", 3, None)])
    assert N.lookup_join(rows, table, "k", "inner").count() == 91
