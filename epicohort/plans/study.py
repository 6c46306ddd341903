"""The study's stages as DataFrame compositions.

Stage 1a: flag episodes, pick the index event (exposed), build the never
exposed population.  1b: event-month distribution, pseudo event dates.
1c: linkage to registries, deaths and areas; age and survival rules.
1d: matched stratified sample of the unexposed.  1e: person x month panel
with pay and recent births.  4a: analysis variables for both cohorts.
Every stage returns a DataFrame.  A finished stage is written when it is first
asked for, and the analysis stage reads one quantile of pay to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epicohort.config import FIXTURE_CONFIG, StudyConfig
from epicohort.operators import cohort as C
from epicohort.operators import flow as FL
from epicohort.operators import link as L
from epicohort.operators import panel as P
from epicohort.operators import sample as S
from epicohort.functions.recode import five_year_bands
from epicohort.sources.fixtures import DIAG_CODES, OP_CODES, OP_DATES, SLOT_ORDER, FixtureTables
from epicohort.sources.io import drop_version, new_version, read_stage, write_stage

STRATA = ["census_sex", "five_year_bands"]


class Study:
    """One study over one set of input tables (lazy DataFrames, cached per object)."""

    def __init__(self, tables: FixtureTables, cfg: StudyConfig = FIXTURE_CONFIG, materialize: bool = True,
                 allow_short: bool = False):
        """``allow_short``: take strata that are too small whole (see ``shortfall``); otherwise they raise."""
        self.allow_short = allow_short
        self.t = tables
        self.cfg = cfg
        self.materialize = materialize
        self.version = new_version()
        self._kept: dict = {}

    def kept(self, key, make):
        """What ``make()`` gives, computed once for this study (fits and other bounded results)."""
        if key not in self._kept:
            self._kept[key] = make()
        return self._kept[key]

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """S6 + S2: persist a finished stage in the shared checkpoint folder and
        continue from the written table (lineage cut, no recomputation)."""
        if not self.materialize:
            return df
        write_stage(df, name, self.version)
        return read_stage(df.sparkSession, name, self.version)

    def close(self) -> None:
        """Remove the study's stage tables; its DataFrames cannot be read any more."""
        self._kept.clear()
        drop_version(self.t.spark, self.version)

    # ---------------------------------------------------------------- 1a
    @cached_property
    def flagged(self) -> DataFrame:
        """Every episode with episode flags and person flags."""
        lines = C.line_flags(self.t.episode_lines, self.cfg, "epikey", SLOT_ORDER, OP_CODES, OP_DATES, DIAG_CODES)
        return self.stage("flagged", C.person_flags(self.stage("episode_flags", C.flag_line_episodes(self.t.episode_heads, lines, self.cfg))))

    def exposure_stages(self):
        op = F.col("metabolic_op_flag") == 1
        return [
            ("all episodes", None),
            ("episodes with a person id", F.col("census_id_final").isNotNull()),
            ("episodes in follow-up", C.window_predicate(self.cfg)),
            ("procedure episodes in follow-up", op),
            ("without earlier procedure", F.col("any_prev_metab_surgery_flag") == 0),
            ("with qualifying diagnosis", C.diagnosis_predicate()),
        ]

    @cached_property
    def procedure_episodes(self) -> DataFrame:
        """Episodes that pass every exposure stage, with code, type and date."""
        cond = F.lit(True)
        for _, pred in self.exposure_stages()[1:]:
            cond = cond & pred
        return C.procedure_type(self.flagged.where(cond), self.cfg)

    @cached_property
    def exposed(self) -> DataFrame:
        """One index episode per person (W2, P9 imputation, W3)."""
        ep = self.procedure_episodes.withColumn(
            "op_date", C.impute_sentinel("op_date", self.cfg.sentinel_cutoff, "epistart"))
        idx = C.index_event(ep)
        idx = C.tie_break(idx, ["census_id_final", "epistart", "epiend"], "op_date", "epikey")
        return self.stage("exposed", idx.select(
            "census_id_final", "census_id_flag", "epikey", "epistart", "epiend", "op_code", "operation_type",
            "op_date", "primary_obesity_flag", "secondary_obesity_flag", "associated_cond_flag"))

    def exposure_flow(self) -> DataFrame:
        stages = FL.flow_counts(self.flagged, "census_id_final", self.exposure_stages())
        final = FL.frame_counts(self.exposed, "census_id_final", "index episode per person", 7)
        return FL.concat_flows(stages, final)

    @cached_property
    def person_surgery(self) -> DataFrame:
        """Per wave-A id: any procedure before / inside the window."""
        return (self.flagged.where(F.col("census_person_id_2011").isNotNull())
                .groupBy(F.col("census_person_id_2011").alias("census_id_final"))
                .agg(F.max("previous_surgery").alias("any_prev_metab_surgery_flag"),
                     F.max("surgery_in_follow_up").alias("any_metabolic_op_flag_in_dates")))

    @cached_property
    def unexposed(self) -> DataFrame:
        """Wave-A registry people with no procedure in or before the window."""
        people = self.t.registry_2011.select(F.col("il4_person_id").alias("census_id_final"))
        any_op = self.person_surgery.where((F.col("any_prev_metab_surgery_flag") == 1)
                                           | (F.col("any_metabolic_op_flag_in_dates") == 1))
        return self.stage("unexposed", C.exclude(people, any_op.select("census_id_final"), "census_id_final")
                          .withColumn("census_id_flag", F.lit(1)))

    def unexposed_flow(self) -> DataFrame:
        people = self.t.registry_2011.select(F.col("il4_person_id").alias("census_id_final"))
        j = people.join(self.person_surgery, "census_id_final", "left")
        return FL.flow_counts(j, "census_id_final", [
            ("registry people", None),
            ("no procedure in follow-up", F.coalesce(F.col("any_metabolic_op_flag_in_dates"), F.lit(0)) == 0),
            ("no earlier procedure", F.coalesce(F.col("any_prev_metab_surgery_flag"), F.lit(0)) == 0),
        ])

    # ---------------------------------------------------------------- 1b
    @cached_property
    def distribution(self) -> DataFrame:
        return self.stage("distribution", S.month_distribution(self.exposed, self.cfg))

    @cached_property
    def unexposed_dated(self) -> DataFrame:
        return self.stage("unexposed_dated", S.assign_dates(self.unexposed, self.distribution, self.cfg))

    # ---------------------------------------------------------------- 1c
    @cached_property
    def registry_routes(self) -> dict:
        return {1: L.prepare_registry_2011(self.t.registry_2011),
                0: L.prepare_registry_2021(self.t.registry_2021)}

    @cached_property
    def deaths(self) -> DataFrame:
        return L.deaths_with_dates([self.t.deaths_first, self.t.deaths_repeat])

    def matched(self, people: DataFrame) -> DataFrame:
        """Registry link (inner, by route), earliest death (left, by route), 2021 -> 2011
        area crosswalk, before any filter; ``first_area`` marks one row of each match."""
        df = L.link_two_route(people, self.registry_routes, "inner")
        df = L.link_two_route(df, L.death_routes(self.deaths), "left")
        return L.final_area(L.crosswalk(df, self.t.crosswalk, first="first_area"))

    def with_areas(self, matched: DataFrame) -> DataFrame:
        """England filter and area attributes."""
        df = matched.drop("first_area").where(L.in_country())
        return L.enrich_areas(df, self.t.imd, self.t.rural_urban, self.t.region_lookup)

    def linked_areas(self, people: DataFrame) -> DataFrame:
        return self.with_areas(self.matched(people))

    def linked(self, matched: DataFrame) -> DataFrame:
        df = L.add_index_ages(self.with_areas(matched))
        return L.alive_after_index(L.working_age(df, self.cfg))

    @cached_property
    def exposed_matched(self) -> DataFrame:
        """Kept for the sample flow; the exposed are few against the registries."""
        return self.stage("exposed_matched", self.matched(self.exposed))

    @cached_property
    def exposed_linked(self) -> DataFrame:
        return self.stage("exposed_linked", self.linked(self.exposed_matched))

    @cached_property
    def unexposed_linked(self) -> DataFrame:
        return self.stage("unexposed_linked", self.linked(self.matched(self.unexposed_dated)))

    LINK_STEPS = ("linked to registry", "with deaths", "after area crosswalk", "address in England",
                  "working age at index", "alive after index month")

    def linkage_flow(self, people: DataFrame, matched: DataFrame, start: str) -> DataFrame:
        """A16 for stage 1c: rows and people after each linkage step, from one pass over the
        people and one over their matches.  Deaths and area lookups have one row per
        key, so these joins keep the number of rows."""
        steps = [(self.LINK_STEPS[0], None, F.col("first_area")), (self.LINK_STEPS[1], None, F.col("first_area")),
                 (self.LINK_STEPS[2], None), (self.LINK_STEPS[3], L.in_country()),
                 (self.LINK_STEPS[4], L.in_working_age(self.cfg)), (self.LINK_STEPS[5], L.is_alive_after_index())]
        return FL.concat_flows(FL.frame_counts(people, "census_id_final", start, 1),
                               FL.flow_counts(L.add_index_ages(matched), "census_id_final", steps, first_step=2))

    # ---------------------------------------------------------------- 1d
    @cached_property
    def shares(self) -> DataFrame:
        e = self.exposed_linked.withColumn("five_year_bands", five_year_bands(F.col("age_at_operation")))
        return self.stage("shares", S.strata_shares(e, STRATA))

    def sample(self, total: int | None = None) -> DataFrame:
        total = self.cfg.sample_total if total is None else total
        pop = self.unexposed_linked.withColumn("five_year_bands",
                                               five_year_bands(F.col("age_at_operation"), tails=True))
        targets = S.stratum_targets(self.shares, total)
        return S.stratified_sample(pop, targets, STRATA, self.cfg.seed, check=not self.allow_short).drop("five_year_bands")

    def shortfall(self, total: int | None = None) -> DataFrame:
        """People wanted, available and missing in each stratum of the sample."""
        pop = self.unexposed_linked.withColumn("five_year_bands", five_year_bands(F.col("age_at_operation"), tails=True))
        targets = S.stratum_targets(self.shares, self.cfg.sample_total if total is None else total)
        return S.sample_shortfall(pop, targets, STRATA)

    # ---------------------------------------------------------------- 1e
    @cached_property
    def id_routes(self) -> dict:
        return {1: self.t.person_ids_2011, 0: self.t.person_ids_2021}

    def panel(self, linked: DataFrame) -> DataFrame:
        return P.monthly_panel(linked, self.id_routes, self.t.monthly_pay, self.t.births, self.cfg)

    @cached_property
    def exposed_panel(self) -> DataFrame:
        return self.stage("exposed_panel", self.panel(self.exposed_linked))

    @cached_property
    def unexposed_sample(self) -> DataFrame:
        return self.stage("unexposed_sample", self.sample())

    @cached_property
    def unexposed_panel(self) -> DataFrame:
        return self.stage("unexposed_panel", self.panel(self.unexposed_sample.withColumn("operation_type", F.lit("None"))))

    def panel_flow(self, labels: Sequence[str]) -> DataFrame:
        """A16 for stage 1e: people and person-months through the panel build.  Rows of the linked
        people are counted per person, so three steps come from one pass."""
        one = P.one_row_per_person(self.exposed_linked.select("census_id_final", "lsoa_final", "census_id_flag"))
        rows = self.exposed_linked.groupBy(F.col("census_id_final").alias("_person")).agg(F.count(F.lit(1)).alias("n_areas"))
        links = P.identifier_links(self.id_routes).select("census_id_flag", "census_id_final").distinct()
        people = one.join(rows, F.col("census_id_final").eqNullSafe(F.col("_person"))) \
            .join(links.withColumn("has_id", F.lit(True)), ["census_id_flag", "census_id_final"], "left")
        return FL.concat_flows(
            FL.flow_counts(people, "census_id_final", [(labels[0], None, F.col("n_areas")), (labels[1], None),
                                                       (labels[2], F.col("has_id"))]),
            FL.flow_counts(self.exposed_panel, "census_id_final", [(labels[3], None), (labels[4], F.col("paye_flag") == 1)],
                           first_step=4))

    # ---------------------------------------------------------------- 4a
    ANALYSIS_COLS = ["census_id_final", "t_op", "month_label", "census_sex", "age_monthly", "pay",
                     "disability_binary", "rural_urban", "imd_quintile", "region", "age_bands",
                     "birth_in_1yr", "birth_in_5yr", "ethnic_group_tb", "operation_type"]

    def analysis(self, panel: DataFrame, treated: bool) -> DataFrame:
        """Treatment bins, calendar index, outcomes (winsor quantile per cohort,
        trap 9), treatment group (W8) and cohort constants (P25)."""
        from epicohort.operators.quantiles import quantile_values
        df = P.calendar_index(P.event_bins(panel.select(*self.ANALYSIS_COLS)), self.cfg)
        q_hi = quantile_values(df, "pay", [0.9999])[0]
        if q_hi is None:
            raise ValueError("no pay to take the upper quantile of")
        df = P.outcomes(df, q_hi, self.t.deflator)
        if treated:
            df = P.value_where(df, "census_id_final", "six_month_num", F.col("t_op") == 1, "treatment_group")
            return df.withColumn("treat", F.lit(1)).where(F.col("t_op") <= self.cfg.event_window[1])
        return df.withColumns({"treat": F.lit(0), "treatment_group": F.lit(0).cast("long")})

    @cached_property
    def exposed_analysis(self) -> DataFrame:
        return self.stage("exposed_analysis", self.analysis(self.exposed_panel, True))

    @cached_property
    def unexposed_analysis(self) -> DataFrame:
        return self.stage("unexposed_analysis", self.analysis(self.unexposed_panel, False))

    @cached_property
    def combined(self) -> DataFrame:
        """Unexposed at bin 0 at all times, treat 0, group 0, type 'None'."""
        u = self.unexposed_analysis.withColumns({"t_treatment_6_month": F.lit(0).cast("long"),
                                                 "t_treatment_6_month_baseline": F.lit(0).cast("long")})
        return self.exposed_analysis.unionByName(u, allowMissingColumns=True)
