"""Slot families hold every line of an episode, however many."""
import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as E
from epicohort.config import FIXTURE_CONFIG as CFG
from epicohort.functions import slots as S
from epicohort.sources.fixtures import DRIVER_TABLES

SF = "/root/testdata/sf0.001"


def test_codes_and_dates_of_late_lines_count(spark, tmp_path):
    code = sorted(CFG.procedure_codes)[0]
    listed = (900001, code.rsplit("-", 1)[0], code.rsplit("-", 1)[1])
    table = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in DRIVER_TABLES}
    parts = spark.createDataFrame([listed, (900002, "none", "none"), (900003, "none", CFG.diag_codes[0])], "p_partkey long, p_brand string, p_type string")
    # order 1: the listed procedure on line 27 of 30, the listed diagnosis on line 22
    lines = spark.createDataFrame([(1, 900001 if k == 27 else 900003 if k == 22 else 900002, k, dt.date(1998, 1, k)) for k in range(1, 31)],
                                  "l_orderkey long, l_partkey long, l_linenumber int, ship date")
    lines = lines.withColumn("l_shipdate", F.col("ship").cast(table["lineitem"].schema["l_shipdate"].dataType)).drop("ship")
    for name, new, key in (("part", parts, None), ("lineitem", lines, "l_orderkey"), ("orders", None, "o_orderkey")):
        like = table[name].limit(0)
        if new is None:
            table[name] = table[name].limit(1).withColumn(key, F.lit(1).cast(like.schema[key].dataType))
        else:
            table[name] = like.unionByName(new.select(*[F.col(c).cast(like.schema[c].dataType) for c in new.columns]), allowMissingColumns=True)
    for name, df in table.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    flags = E.queries()["code_flags"](spark, str(tmp_path)).collect()
    assert [(r["metabolic_op_flag"], r["secondary_obesity_flag"], r["primary_obesity_flag"]) for r in flags] == [(1, 1, 0)]
    first = E.queries()["first_code_and_date"](spark, str(tmp_path)).collect()
    assert [(r["op_code"], r["op_date"], r["operation_type"]) for r in first] == [(code, dt.date(1998, 1, 27), CFG.procedure_codes[code])]


def test_array_and_wide_families_agree(spark):
    rows = [("a", "x", None, 1, 2, 3), (None, "x", "a", 4, 5, 6), ("b", None, "x", 7, 8, 9), ("x", "x", "b", 1, 2, 3), (None,) * 6]
    df = spark.createDataFrame(rows, "c1 string, c2 string, c3 string, v1 int, v2 int, v3 int")
    wide, values = ["c1", "c2", "c3"], ["v1", "v2", "v3"]
    df = df.withColumns({"c": F.array(*wide), "v": F.array(*values)})
    of = lambda c, v: [S.any_slot_in(c, ["x"]), S.secondary_only(c, ["x"]), S.slot_in(S.first_slot(c), ["x"]), S.first_match(c, ["x"], v)]
    got = [tuple(r) for r in df.select(*of("c", "v"), *of(wide, values)).collect()]
    assert all(r[:4] == r[4:] for r in got)
    assert [r[:3] for r in got] == [(1, 1, 0), (1, 0, 0), (1, 1, 0), (1, 0, 1), (0, 0, 0)]
    assert [r[3] and tuple(r[3]) for r in got] == [(2, "x", 2), (2, "x", 5), (3, "x", 9), (1, "x", 1), None]
    none = df.limit(1).withColumn("c", F.lit(None).cast("array<string>"))
    assert [tuple(r) for r in none.select(*of("c", "c")).collect()] == [(0, 0, 0, None)]
