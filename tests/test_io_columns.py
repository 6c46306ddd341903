"""S5, S6/S2, S8/S9, P24, L14."""
import os
import tempfile

from epicohort.functions.columns import (drop_matching, reference_of, rename_regex, select_matching,
                                         set_reference)
from epicohort.sources.io import read_lookup, read_results, read_stage, write_results, write_stage


def test_lookup_csv_with_bom(spark):
    d = tempfile.mkdtemp(prefix="epicohort-io-")
    p = os.path.join(d, "codes.csv")
    with open(p, "w", encoding="utf-8-sig") as fh:
        fh.write("Name,Code\nsleeve,G285\nband,G303\n")
    df = read_lookup(spark, p, "Name string, Code string")
    assert sorted(r.Code for r in df.collect()) == ["G285", "G303"]
    assert df.columns == ["Name", "Code"]


def test_stage_round_trip_and_results(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    write_stage(df, "t", "v1")
    assert read_stage(spark, "t", "v1").count() == 2
    d = tempfile.mkdtemp(prefix="epicohort-res-")
    write_results({"flow": df}, d)
    assert read_results(spark, d, "flow").count() == 2


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "id int, opdate_01 int, opdate_02 int, x_date int")
    assert select_matching(df, r"^opdate_", keep=("id",)).columns == ["id", "opdate_01", "opdate_02"]
    assert drop_matching(df, "opdate").columns == ["id", "x_date"]
    assert "x" in rename_regex(df, "_date", "", prefix="x").columns
    assert reference_of(set_reference(df, {"id": 1}), "id") == "1"
