"""Attribute recodes, age bands and classification ladders.

Recodes are data: a list of (predicate spec, label) evaluated first match
wins, turned into one CASE expression.  String codes are compared through
``try_cast`` so 'X' / 'XX' / 'XXXX' never raise under ANSI mode; they fall
to the default label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "Missing or not stated"

# ---------------------------------------------------------------------------
# Category labels and code ranges of the two census waves, as
# the reference study defines them.  Each entry is (low, high, label) with
# both ends inclusive, or (value,) lists for exact matches.
# ---------------------------------------------------------------------------
ETHNIC_2021 = [(1, 5, "White"), (6, 9, "Mixed"), (10, 14, "Asian"), (15, 17, "Black"), (18, 19, "Other")]
ETHNIC_2011 = [(1, 4, "White"), (5, 8, "Mixed"), (9, 13, "Asian"), (14, 16, "Black"), (17, 18, "Other")]
DISABILITY_2021 = [(1, 1, "Yes - reduced a lot"), (2, 2, "Yes - reduced a little"), (3, 4, "No")]
DISABILITY_2011 = [(1, 1, "Yes - reduced a lot"), (2, 2, "Yes - reduced a little"), (3, 3, "No")]
NSSEC_LABELS = [
    "Higher managerial, administrative and professional occupations",
    "Lower managerial, administrative and professional occupations",
    "Intermediate occupations",
    "Small employers and own account workers",
    "Lower supervisory and technical occupations",
    "Semi-routine occupations",
    "Routine occupations",
    "Never worked",
    "Long-term unemployed",
    "Full-Time students",
]
NSSEC_2021 = [(1, 3, NSSEC_LABELS[0]), (4, 6, NSSEC_LABELS[1]), (7, 7, NSSEC_LABELS[2]), (8, 9, NSSEC_LABELS[3]),
              (10, 11, NSSEC_LABELS[4]), (12, 12, NSSEC_LABELS[5]), (13, 13, NSSEC_LABELS[6]),
              (14, 14, NSSEC_LABELS[7]), (15, 15, NSSEC_LABELS[8]), (16, 16, NSSEC_LABELS[9])]
# 2011 NS-SEC uses half-open decimal ranges and two decimal codes.
NSSEC_2011_HALF_OPEN = [(1, 4, NSSEC_LABELS[0]), (4, 7, NSSEC_LABELS[1]), (7, 8, NSSEC_LABELS[2]),
                        (8, 10, NSSEC_LABELS[3]), (10, 12, NSSEC_LABELS[4]), (12, 13, NSSEC_LABELS[5]),
                        (13, 14, NSSEC_LABELS[6])]
NSSEC_2011_EXACT = [(14.1, NSSEC_LABELS[7]), (14.2, NSSEC_LABELS[8])]
NSSEC_2011_TAIL = [(15, 16, NSSEC_LABELS[9])]
RELIGION_LABELS = ["No religion", "Christian", "Buddhist", "Hindu", "Jewish", "Muslim", "Sikh", "Other religion",
                   MISSING]
QUALIFICATION_LABELS = ["No qualifications", "Level 1 qualifications", "Level 2 qualifications", "Apprenticeship",
                        "Level 3 qualifications", "Level 4 qualifications and above",
                        "Other: Vocational/Work-related qualifications/Foreign qualifications)"]
PARTNERSHIP_LABELS = ["Never married and never registered a civil partnership",
                      "Married or in a registered civil partnership",
                      "Separated, but still legally married or still legally in a civil partnership",
                      "Divorced or civil partnership dissolved",
                      "Widowed or surviving civil partnership partner"]
PARTNERSHIP_2021 = [(1, 1, PARTNERSHIP_LABELS[0]), (2, 5, PARTNERSHIP_LABELS[1]), (6, 7, PARTNERSHIP_LABELS[2]),
                    (8, 9, PARTNERSHIP_LABELS[3]), (10, 11, PARTNERSHIP_LABELS[4])]
# 2011 marital status: codes (a, b) both map to one label.
PARTNERSHIP_2011 = [((1,), PARTNERSHIP_LABELS[0]), ((2, 6), PARTNERSHIP_LABELS[1]), ((3, 7), PARTNERSHIP_LABELS[2]),
                    ((4, 8), PARTNERSHIP_LABELS[3]), ((5, 9), PARTNERSHIP_LABELS[4])]
SEX_2021 = {1: "Females", 2: "Males"}
SEX_2011 = {1: "Males", 2: "Females"}
TEN_YEAR_BANDS = [(25, 35, "25-34"), (35, 45, "35-44"), (45, 55, "45-54"), (55, 65, "55-64")]
TEN_YEAR_DEFAULT = "Out of age range"
FIVE_YEAR_BANDS = [(25, 30, "25-29"), (30, 35, "30-34"), (35, 40, "35-39"), (40, 45, "40-44"),
                   (45, 50, "45-49"), (50, 55, "50-54"), (55, 60, "55-59"), (60, 65, "60-64")]
FIVE_YEAR_LOW_TAIL = [(None, 20, "Under 20"), (20, 25, "21-24")]
FIVE_YEAR_HIGH_TAIL = [(65, None, "Over 65")]
# ---------------------------------------------------------------------------


def num(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("string").try_cast("double")


def ranges(x: Column, spec: Sequence[tuple], default=MISSING, half_open: bool = False) -> Column:
    """CASE over (lo, hi, label); inclusive ends unless ``half_open`` ([lo, hi))."""
    expr = None
    for lo, hi, label in spec:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (x >= F.lit(lo))
        if hi is not None:
            cond = cond & ((x < F.lit(hi)) if half_open else (x <= F.lit(hi)))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default) if default is not None else F.lit(None).cast("string"))


def exact(x: Column, mapping: Sequence[tuple], default=MISSING) -> Column:
    """CASE over (values-tuple or value, label)."""
    expr = None
    for values, label in mapping:
        vals = values if isinstance(values, tuple) else (values,)
        cond = x.isin(list(vals))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default) if default is not None else F.lit(None).cast("string"))


def recode_2021(df):
    """P20: 2021-wave attribute recodes (1 = Females)."""
    dis = num("disability")
    return df.withColumns({
        "census_sex": exact(num("sex"), list(SEX_2021.items()), default=None),
        "ethnic_group_tb": ranges(num("ethnic_group_tb"), ETHNIC_2021),
        "disability_category": ranges(dis, DISABILITY_2021),
        "disability_binary": F.when((dis >= 1) & (dis <= 2), 1).otherwise(0),
        "ns_sec": ranges(num("ns_sec"), NSSEC_2021),
        "religion_tb": exact(num("religion_tb"), [(i + 1, lab) for i, lab in enumerate(RELIGION_LABELS)]),
        "highest_qualification": exact(num("highest_qualification"),
                                       [(i, lab) for i, lab in enumerate(QUALIFICATION_LABELS)]),
        "legal_partnership_status": ranges(num("legal_partnership_status"), PARTNERSHIP_2021),
    })


def recode_2011(df):
    """2011-wave recodes (1 = Males); string codes with 'X' markers, decimal NS-SEC."""
    dis = num("disability")
    ns = num("nssec")
    nssec = (ranges(ns, NSSEC_2011_HALF_OPEN, default=None, half_open=True))
    for v, lab in NSSEC_2011_EXACT:
        nssec = F.coalesce(nssec, F.when(ns == F.lit(v), F.lit(lab)))
    nssec = F.coalesce(nssec, ranges(ns, NSSEC_2011_TAIL, default=MISSING, half_open=True))
    return df.withColumns({
        "census_sex": exact(num("sex"), list(SEX_2011.items()), default=None),
        "ethnic_group_tb": ranges(num("ethpuk11"), ETHNIC_2011),
        "disability_category": ranges(dis, DISABILITY_2011),
        "disability_binary": F.when((dis >= 1) & (dis <= 2), 1).otherwise(0),
        "ns_sec": nssec,
        "religion_tb": exact(num("RELPUK11"), [(i + 1, lab) for i, lab in enumerate(RELIGION_LABELS)]),
        "highest_qualification": exact(num("HLQPUK11"),
                                       [(i + 10, lab) for i, lab in enumerate(QUALIFICATION_LABELS)]),
        "legal_partnership_status": exact(num("MARSTAT"), PARTNERSHIP_2011),
    })


def age_bands(age: Column) -> Column:
    """Ten-year bands, default 'Out of age range'."""
    return ranges(age, TEN_YEAR_BANDS, default=TEN_YEAR_DEFAULT, half_open=True)


def five_year_bands(age: Column, tails: bool = False) -> Column:
    """Five-year bands 25-64 (NULL outside); with ``tails`` the low
    'Under 20' / '21-24' (which covers 20) and high 'Over 65' bands too."""
    spec = (FIVE_YEAR_LOW_TAIL + FIVE_YEAR_BANDS + FIVE_YEAR_HIGH_TAIL) if tails else FIVE_YEAR_BANDS
    return ranges(age, spec, default=None, half_open=True)


def classify_regex(col: Column, rules: Sequence[tuple], default: str = "Error") -> Column:
    """First matching (regex, label) wins, else ``default``."""
    expr = None
    for pattern, label in rules:
        cond = col.rlike(pattern)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def between_both(cols: Sequence[Column], lo, hi) -> Column:
    """Every column within [lo, hi]."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & c.between(lo, hi)
    return cond
