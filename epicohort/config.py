"""One frozen configuration object for a study.

The reference spreads its parameters over scripts (follow-up dates, origin
month, code lists, age limits, sample size).  Here they live together so
that every stage of one study reads the same values (SURVEY trap 21).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class StudyConfig:
    # follow-up window, half open [start, end)
    follow_up_start: dt.date
    follow_up_end: dt.date
    # month 0 of the event-month distribution and of the calendar index
    origin: dt.date
    # procedure code -> procedure type
    procedure_codes: dict = field(default_factory=dict)
    # primary-diagnosis codes and associated-condition codes
    diag_codes: tuple = ()
    associated_codes: tuple = ()
    # sentinel handling of dates
    sentinel_cutoff: dt.date = dt.date(1850, 1, 1)
    episode_end_guard: dt.date = dt.date(1802, 1, 1)
    # which episode date must lie before the window end for an in-window event
    in_window_end_col: str = "epiend"
    # ages
    working_age: tuple = (25, 64)
    panel_age: tuple = (21, 69)
    event_window: tuple = (-59, 60)
    # matched sample
    sample_total: int = 50000
    seed: str = "42"
    # spine of month ends runs over [spine_start, spine_end)
    spine_start: dt.date | None = None
    spine_end: dt.date | None = None

    @property
    def procedure_code_list(self) -> list:
        return sorted(self.procedure_codes)

    @property
    def months_in_spine(self) -> int:
        s, e = self.spine_bounds
        return (e.year - s.year) * 12 + (e.month - s.month)

    @property
    def spine_bounds(self) -> tuple:
        return (self.spine_start or self.follow_up_start, self.spine_end or self.follow_up_end)

    def with_(self, **kw) -> "StudyConfig":
        return replace(self, **kw)


# Fixed values of the reference study (dates from its configuration, code
# lists from its three lookup files, sample size from its sampling stage).
REFERENCE_CONFIG = StudyConfig(
    follow_up_start=dt.date(2014, 4, 1),
    follow_up_end=dt.date(2023, 1, 1),
    origin=dt.date(2014, 4, 1),
    procedure_codes={
        "G281": "bypass_one_anastomosis",
        "G282": "sleeve_duodenal_switch",
        "G283": "sleeve_duodenal_switch",
        "G284": "sleeve_duodenal_switch",
        "G285": "sleeve_gastrectomy",
        "G301": "endoscopic_sleeve_gastroplasty",
        "G302": "bypass_one_anastomosis",
        "G303": "gastric_band",
        "G304": "bypass_one_anastomosis",
        "G312": "bypass_one_anastomosis",
        "G321": "roux_en_y_bypass",
        "G331": "roux_en_y_bypass",
        "G716": "sleeve_duodenal_switch",
        "G481": "gastric_balloon",
        "G485": "gastric_balloon",
    },
    diag_codes=("E66", "E660", "E661", "E662", "E668", "E669"),
    associated_codes=(
        "K44", "K440", "K441", "K449", "K21", "K210", "K219", "K29", "K290",
        "K291", "K292", "K293", "K294", "K295", "K296", "K297", "K298", "K299",
        "R11X",
    ),
    sample_total=50000,
)

# Study on the driver's TPC-H-shaped tables (FIXTURES.md part B): the window
# is 1997-01-01..2000-01-01 and codes are brand/type strings.
FIXTURE_CONFIG = StudyConfig(
    follow_up_start=dt.date(1997, 1, 1),
    follow_up_end=dt.date(2000, 1, 1),
    origin=dt.date(1997, 1, 1),
    procedure_codes={
        "Brand#11-E": "type_a",
        "Brand#11-L": "type_a",
        "Brand#11-M": "type_a",
        "Brand#11-P": "type_b",
        "Brand#11-S": "type_b",
    },
    diag_codes=("PROMO",),
    associated_codes=("ECONOMY", "SMALL"),
    sentinel_cutoff=dt.date(1996, 1, 1),
    in_window_end_col="epistart",
    sample_total=300,
    seed="42",
)
