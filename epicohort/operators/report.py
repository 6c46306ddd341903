"""Result tables of model fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stars(p):
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(""))


def significance_table(tidy: DataFrame, fit_stats: dict | None = None, digits: int = 1) -> DataFrame:
    """M12: 'est*** (lo, hi)' text per term; AIC and BIC appended as rows."""
    fmt = f"%.{digits}f"
    out = tidy.select("term", F.format_string(f"{fmt}%s ({fmt}, {fmt})", F.col("estimate"), stars(F.col("p_value")),
                                              F.col("conf_low"), F.col("conf_high")).alias("value"))
    if fit_stats:
        spark = tidy.sparkSession
        extra = spark.createDataFrame([(k.upper(), fmt % fit_stats[k]) for k in ("aic", "bic")], "term string, value string")
        out = out.unionByName(extra)
    return out


def compare_models(tidies: dict, value: str = "estimate") -> DataFrame:
    """M13 (n-way J11): one row per term, one column per model."""
    long = None
    for name, t in tidies.items():
        part = t.select("term", F.lit(name).alias("model"), F.col(value).alias("v"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy("term").pivot("model", list(tidies)).agg(F.first("v"))


def compare_significance(models: dict, digits: int = 1) -> DataFrame:
    """The models' text tables side by side: one row per term and for AIC and BIC,
    one column per model (``models``: name -> (tidy rows, fit statistics)); a term that a
    model lacks is NULL there."""
    long = None
    for name, (tidy, stats) in models.items():
        part = significance_table(tidy, stats, digits).withColumn("model", F.lit(name))
        long = part if long is None else long.unionByName(part)
    return long.groupBy("term").pivot("model", list(models)).agg(F.first("value"))


def compare_tables(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join of two result tables by label."""
    return a.join(b, on=list(on), how="full_outer")
