"""Episode flags, person-level flags, index event and cohort exclusion
(P1-P10, W1-W3, J7)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epicohort.config import StudyConfig
from epicohort.functions.dates import lit_date
from epicohort.functions.slots import any_slot_in, first_match, first_slot, secondary_only, slot_in
from epicohort.sources.fixtures import DIAG_COLS, OP_COLS, OPDATE_COLS
from epicohort.sources.io import stash


def line_flags(lines: DataFrame, cfg: StudyConfig, key: str, order: Sequence[str], code: str, date: str, diag: str) -> DataFrame:
    """P1-P5 from one row per slot: per episode its first diagnosis, whether any
    diagnosis and any procedure is listed, the first listed procedure with its date, and the
    last date.  All are minima and maxima (map-side combined), so an episode of any
    number of lines is never gathered."""
    listed_code = F.col(code).isin(sorted(cfg.procedure_codes))
    first = F.min(F.when(listed_code, F.struct(*order, F.col(code).alias("code"), F.col(date).alias("date"))))
    return lines.groupBy(key).agg(
        F.min(F.struct(*order, F.col(diag).alias("diag")))["diag"].alias("first_diag"),
        F.max(F.col(diag).isin(sorted(cfg.diag_codes)).cast("int")).alias("any_diag"),
        F.max(listed_code.cast("int")).alias("any_code"), first["code"].alias("op_code"), first["date"].alias("op_date"),
        F.max(date).alias("last_date"))


def flag_line_episodes(heads: DataFrame, flags: DataFrame, cfg: StudyConfig, key: str = "epikey", start: str = "epistart",
                       id_a: str = "census_person_id_2011", id_b: str = "census_id_2021") -> DataFrame:
    """``flag_episodes`` with the first listed code and its date, for episodes whose slots are
    summed up by ``line_flags``; an episode ends on its last date, or where it starts."""
    ep = heads.join(flags, key, "left").withColumn("epiend", F.greatest(F.col(start), F.col("last_date")))
    primary = F.col("first_diag").isin(sorted(cfg.diag_codes))
    out = ep.withColumns({
        "primary_obesity_flag": F.when(primary, 1).otherwise(0),
        "secondary_obesity_flag": F.when(~primary & (F.col("any_diag") == 1), 1).otherwise(0),
        "associated_cond_flag": slot_in("first_diag", cfg.associated_codes),
        "metabolic_op_flag": F.coalesce("any_code", F.lit(0)),
    }).drop("first_diag", "any_diag", "any_code", "last_date")
    return _windows(out, cfg, id_a, id_b)


def flag_episodes(ep: DataFrame, cfg: StudyConfig, op_cols: str | Sequence[str] = OP_COLS,
                  diag_cols: str | Sequence[str] = DIAG_COLS, id_a: str = "census_person_id_2011",
                  id_b: str = "census_id_2021") -> DataFrame:
    """Episode-level 0/1 flags (NULL -> 0), the chosen person id and the
    before-window / in-window event flags (P1-P3, P6, P7)."""
    out = ep.withColumns({
        "primary_obesity_flag": slot_in(first_slot(diag_cols), cfg.diag_codes),
        "secondary_obesity_flag": secondary_only(diag_cols, cfg.diag_codes),
        "associated_cond_flag": slot_in(first_slot(diag_cols), cfg.associated_codes),
        "metabolic_op_flag": any_slot_in(op_cols, cfg.procedure_codes),
    })
    return _windows(out, cfg, id_a, id_b)


def _windows(flagged: DataFrame, cfg: StudyConfig, id_a: str, id_b: str) -> DataFrame:
    """The chosen person id, and the event before or inside the window."""
    start, end = lit_date(cfg.follow_up_start), lit_date(cfg.follow_up_end)
    out = flagged.withColumn("census_id_flag", F.when(F.col(id_a).isNotNull(), 1).otherwise(0))
    op = F.col("metabolic_op_flag") == 1
    return out.withColumns({
        "census_id_final": F.when(F.col("census_id_flag") == 1, F.col(id_a)).otherwise(F.col(id_b)),
        "previous_surgery": F.when((F.col("epistart") < start) & op, 1).otherwise(0),
        "surgery_in_follow_up": F.when(
            (F.col("epistart") >= start) & (F.col(cfg.in_window_end_col) < end) & op, 1).otherwise(0),
    })


def per_key(df: DataFrame, keys: Sequence[str], aggs: dict) -> DataFrame:
    """Attach per-key aggregates to every row with a key: a grouped aggregate
    (map-side combined, so a key holding a third of the rows costs one row per
    task), stored and joined back.  Used in place of
    ``agg().over(partitionBy(key))``, which would put a hot key's rows into one task.
    As the aggregate is stored, the join has a plain exchange on either side (or a
    broadcast, if the table is small enough for Spark's own limit), which AQE can split
    for a hot key; an aggregate joined in the same plan would sit between its
    exchange and the join and prevent that."""
    stats = stash(df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(*[e.alias(n) for n, e in aggs.items()]), "per_key")
    same = [F.col(k) == F.col(f"_key_{k}") for k in keys]
    return df.join(stats, same, "inner").drop(*[f"_key_{k}" for k in keys])


def any_flag_over(df: DataFrame, id_col: str, flags: dict) -> DataFrame:
    """Person-level 'any' of episode flags on every row of the person.

    Only rows that raise a flag are aggregated; the small table of people who
    have one is joined to all rows (no shuffle of those where Spark broadcasts
    it, a split one otherwise).  Rows without an id are kept apart (NULL person
    flags) so they never form one giant group."""
    raised = reduce(lambda a, b: a | b, [F.col(flag) == 1 for flag in flags.values()])
    some = stash(df.where(F.col(id_col).isNotNull() & raised).groupBy(F.col(id_col).alias("_key"))
                  .agg(*[F.max(F.col(flag)).alias(out) for out, flag in flags.items()]), "any_flag")
    keyed = df.where(F.col(id_col).isNotNull()).join(some, F.col(id_col) == F.col("_key"), "left").drop("_key")
    keyed = keyed.withColumns({out: F.coalesce(F.col(out), F.lit(0)) for out in flags})
    unkeyed = df.where(F.col(id_col).isNull()).withColumns(
        {out: F.lit(None).cast("int") for out in flags})
    return keyed.unionByName(unkeyed)


def person_flags(flagged: DataFrame) -> DataFrame:
    return any_flag_over(flagged, "census_id_final", {
        "any_prev_metab_surgery_flag": "previous_surgery",
        "any_metabolic_op_flag_in_dates": "surgery_in_follow_up",
    })


def in_window(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Half-open follow-up window plus the end-date sentinel guard."""
    return df.where(window_predicate(cfg))


def window_predicate(cfg: StudyConfig):
    return ((F.col("epistart") >= lit_date(cfg.follow_up_start))
            & (F.col(cfg.in_window_end_col) < lit_date(cfg.follow_up_end))
            & (F.col("epiend") > lit_date(cfg.episode_end_guard)))


def diagnosis_predicate():
    """P10: primary diagnosis, or secondary diagnosis with a primary associated condition."""
    return (F.col("primary_obesity_flag") == 1) | (
        (F.col("secondary_obesity_flag") == 1) & (F.col("associated_cond_flag") == 1))


def first_procedure(df: DataFrame, cfg: StudyConfig, code_cols: str | Sequence[str] = OP_COLS,
                    date_cols: str | Sequence[str] = OPDATE_COLS) -> DataFrame:
    """P4 + P5 + J1: first listed procedure code in slot order, its slot date,
    and its type through a lookup join."""
    m = first_match(code_cols, cfg.procedure_codes, date_cols)
    lookup = procedure_lookup(df.sparkSession, cfg)
    out = df.withColumns({"op_code": m["code"], "op_date": m["value"]})
    return (out.join(lookup, out["op_code"] == lookup["Code"], "left")
               .drop("Code").withColumnRenamed("Name", "operation_type"))


def with_first_procedure(df: DataFrame, cfg: StudyConfig, code_cols: str | Sequence[str] = OP_COLS,
                         date_cols: str | Sequence[str] = OPDATE_COLS) -> DataFrame:
    """P4 + P5 only: first listed code and its slot date (NULL when none)."""
    m = first_match(code_cols, cfg.procedure_codes, date_cols)
    return df.withColumns({"op_code": m["code"], "op_date": m["value"]})


def procedure_type(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Procedure type of ``op_code`` through the code lookup."""
    lookup = procedure_lookup(df.sparkSession, cfg)
    return (df.join(lookup, df["op_code"] == lookup["Code"], "left")
              .drop("Code").withColumnRenamed("Name", "operation_type"))


def procedure_lookup(spark, cfg: StudyConfig) -> DataFrame:
    """The code -> type lookup as a small DataFrame (bounded by the code list)."""
    rows = sorted(cfg.procedure_codes.items())
    return spark.createDataFrame(rows, "Code string, Name string")


def impute_sentinel(col: str, cutoff, replacement: str):
    """Dates before the cutoff take the replacement column; NULL stays NULL."""
    return F.when(F.col(col) < lit_date(cutoff), F.col(replacement)).otherwise(F.col(col))


def index_event(df: DataFrame, id_col: str = "census_id_final", start: str = "epistart",
                end: str = "epiend") -> DataFrame:
    """Rows holding both the person's earliest start and earliest end.
    A person with no row holding both minima drops out (as in the reference)."""
    return (per_key(df, [id_col], {"_min_s": F.min(start), "_min_e": F.min(end)})
            .where((F.col(start) == F.col("_min_s")) & (F.col(end) == F.col("_min_e")))
            .drop("_min_s", "_min_e"))


def tie_break(df: DataFrame, part_cols: Sequence[str], asc_col: str = "op_date",
              desc_col: str = "epikey") -> DataFrame:
    """Earliest ``asc_col`` within the partition, then the largest
    ``desc_col`` among those rows; rows with NULL ``asc_col`` never survive.
    Both steps are grouped aggregates joined back (skew safe)."""
    first = (per_key(df, part_cols, {"_min_a": F.min(asc_col)})
             .where(F.col(asc_col) == F.col("_min_a")).drop("_min_a"))
    return (per_key(first, part_cols, {"_max_d": F.max(desc_col)})
            .where(F.col(desc_col) == F.col("_max_d")).drop("_max_d"))


def exclude(df: DataFrame, flagged: DataFrame, on) -> DataFrame:
    """Anti join (the reference's left join + NULL->0 + keep 0)."""
    return df.join(flagged, on=on, how="left_anti")
