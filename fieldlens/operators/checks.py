"""The ten rule modules (D1-D7, E1-E32) as Spark SQL expression text.

Each builder receives the set of column names available at that point of the
run (input columns plus derived columns of earlier modules) and the profile,
and returns a ``ModulePlan``: derived columns, the two sequential checks and
the gated specific checks.  Decisions about absent columns are made here, on
the driver, from column names only (B4).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import profile as P
from ..functions import rules as R
from ..functions.rules import concat, num, num_text, q, text


@dataclass
class Check:
    name: str
    cond: str | None
    message: str
    flag: str | None = None  # full flag expression when not a plain gate
    details: list[str] = field(default_factory=list)  # extra narrative parts when raised


@dataclass
class ModulePlan:
    name: str
    derived: dict[str, str]
    missing: str
    missing_msg: str
    erroneous: str  # may refer to the module's Missing flag by name
    erroneous_msg: str
    checks: list[Check]

    def flag(self, check: str) -> str:
        return f"Flag_{self.name}_{check}"

    @property
    def missing_col(self) -> str:
        return self.flag("Missing")

    @property
    def erroneous_col(self) -> str:
        return self.flag("Erroneous")

    @property
    def flag_columns(self) -> list[str]:
        return [self.missing_col, self.erroneous_col] + [self.flag(c.name) for c in self.checks]


def _present(names, avail) -> list[str]:
    return [n for n in names if n in avail]


def _generic(name, specs, avail, p: P.Profile) -> tuple[str, str, str, str]:
    """C1 + C3 over the declared specs that are present."""
    specs = [s for s in p.specs(tuple(specs)) if s.name in avail]
    required = [s.name for s in specs if s.required]
    erroneous = R.erroneous_when_answered(q(f"Flag_{name}_Missing"), R.any_of([R.out_of_spec(s) for s in specs]))
    return R.missing_any(required), R.missing_text(required), erroneous, R.erroneous_text(specs)


def _scored(declared, weights) -> tuple[P.ColumnSpec, ...]:
    """Specs of the scored columns; a column the standard doesn't declare counts days of a week."""
    known = {s.name: s for s in declared}
    return tuple(known.get(c, P.ColumnSpec(c, "num", 0, 7)) for c in weights)


def _fmt(v: float) -> str:
    return f"{v:,}" if float(v) != int(v) else f"{int(v):,}"


# -- Demo -----------------------------------------------------------------------

def demo(avail: set[str], p: P.Profile) -> ModulePlan:
    t = p.thresholds["Demo"]
    male, female = _present(P.DEMO_MALE, avail), _present(P.DEMO_FEMALE, avail)
    adult, child, f1259 = (_present(x, avail) for x in (P.DEMO_ADULT, P.DEMO_CHILD, P.DEMO_F1259))
    all_groups = list(dict.fromkeys(male + female))
    derived: dict[str, str] = {}
    for out, names in (("Sum_M", male), ("Sum_F", female), ("Sum_All", all_groups),
                       ("Sum_Adults", adult), ("Sum_Children", child), ("Sum_F1259", f1259)):
        if names:
            derived[out] = R.sum_nulls_as_zero(names)
    checks: list[Check] = []
    if "HHSize" in avail:
        thr = t["high_hhsize_threshold"]
        checks.append(Check("HighHHSize", f"`HHSize` > {num(thr)}",
                            concat(text("Household size "), num_text("`HHSize`"), text(f" is above {thr}"))))
        if all_groups:
            tol = t["hhsize_sum_tolerance"]
            checks.append(Check(
                "SumMismatch", f"abs(`Sum_All` - `HHSize`) > {num(tol)}",
                concat(text("Roster total "), num_text("`Sum_All`"), text(" differs from household size "),
                       num_text("`HHSize`"), text(f" by more than {tol}")),
            ))
    if "Sum_Adults" in derived:
        checks.append(Check("NoAdults", "`Sum_Adults` = 0", text("Roster lists no member aged 18 or over")))
    if "HHPregLactNb" in avail and "Sum_F1259" in derived:
        checks.append(Check(
            "PLWExceeds", "`HHPregLactNb` > `Sum_F1259`",
            concat(text("Pregnant/lactating count "), num_text("`HHPregLactNb`"),
                   text(" exceeds females aged 12-59 ("), num_text("`Sum_F1259`"), text(")")),
        ))
    return ModulePlan("Demo", derived, *_generic("Demo", P.DEMO_SPECS, avail, p), checks)


# -- FCS ------------------------------------------------------------------------

def fcg_band(score: str, poor: float, borderline: float) -> str:
    """Left-closed bands Poor < poor <= Borderline < borderline <= Acceptable."""
    return (f"CASE WHEN {score} < {num(poor)} THEN 'Poor' WHEN {score} < {num(borderline)} THEN 'Borderline' "
            f"WHEN {score} >= {num(borderline)} THEN 'Acceptable' END")


def _identical(names: list[str]) -> str:
    """All present answers equal and the first one not zero."""
    cols = ", ".join(q(n) for n in names)
    return f"(greatest({cols}) = least({cols}) AND coalesce({q(names[0])} <> 0, true))"


def fcs(avail: set[str], p: P.Profile) -> ModulePlan:
    t = p.thresholds["FCS"]
    groups = _present(p.fcs_weights, avail)
    gen = _generic("FCS", _scored(P.FCS_SPECS, p.fcs_weights), avail, p)
    if not groups:  # no answers at all: no score and no specific check
        return ModulePlan("FCS", {}, *gen, [])
    derived = {"FCS": R.weighted_sum({g: p.fcs_weights[g] for g in groups}),
               "FCG": fcg_band("`FCS`", t["fcg_poor_threshold"], t["fcg_borderline_threshold"])}
    checks: list[Check] = []
    if len(groups) > 1:
        checks.append(Check("Identical", _identical(groups),
                            text(f"All {len(groups)} food-group answers are the same non-zero value")))
    if "FCSStap" in avail:
        thr = t["low_staple_threshold"]
        checks.append(Check("LowStaple", f"`FCSStap` < {num(thr)}",
                            concat(text("Staples eaten on "), num_text("`FCSStap`"), text(f" days, fewer than {thr}"))))
    low, high = t["low_fcs_threshold"], t["high_fcs_threshold"]
    checks.append(Check("Low", f"`FCS` < {num(low)}", concat(text("FCS "), num_text("`FCS`"), text(f" is below {low}"))))
    checks.append(Check("High", f"`FCS` > {num(high)}", concat(text("FCS "), num_text("`FCS`"), text(f" is above {high}"))))
    return ModulePlan("FCS", derived, *gen, checks)


# -- HDDS -----------------------------------------------------------------------

def hdds(avail: set[str], p: P.Profile) -> ModulePlan:
    low = p.thresholds["HDDS"]["low_hdds_threshold"]
    scored = _present(P.HDDS_SCORED, avail)
    gen = _generic("HDDS", P.HDDS_SPECS, avail, p)
    if not scored:
        return ModulePlan("HDDS", {}, *gen, [])
    checks = [
        Check("Low", f"`HDDS` < {num(low)}",
              concat(text("Dietary diversity "), num_text("`HDDS`"), text(f" is below {low}"))),
        Check("AllGroups", f"`HDDS` = {num(len(scored))}",
              text(f"Every one of the {len(scored)} food groups reported as eaten")),
    ]
    return ModulePlan("HDDS", {"HDDS": R.sum_nulls_as_zero(scored)}, *gen, checks)


# -- rCSI -----------------------------------------------------------------------

def rcsi(avail: set[str], p: P.Profile) -> ModulePlan:
    t = p.thresholds["rCSI"]
    strategies = _present(p.rcsi_weights, avail)
    gen = _generic("rCSI", _scored(P.RCSI_SPECS, p.rcsi_weights), avail, p)
    if not strategies:
        return ModulePlan("rCSI", {}, *gen, [])
    derived = {"rCSI": R.weighted_sum({s: p.rcsi_weights[s] for s in strategies})}
    checks: list[Check] = []
    if t["flag_identical"] and len(strategies) > 1:
        checks.append(Check("Identical", _identical(strategies),
                            text(f"All {len(strategies)} coping answers are the same non-zero value")))
    if "FCG" in avail:
        if t["zero_rcsi_with_poor_fcg"]:
            checks.append(Check("ZeroWithPoorFCG", "`FCG` = 'Poor' AND `rCSI` = 0",
                                text("No coping reported although food consumption is Poor")))
        high = t["high_rcsi_with_acceptable_fcg"]
        checks.append(Check("HighWithAcceptFCG", f"`FCG` = 'Acceptable' AND `rCSI` > {num(high)}",
                            concat(text("rCSI "), num_text("`rCSI`"),
                                   text(f" above {high} although food consumption is Acceptable"))))
    if "rCSIMealAdult" in avail and "Sum_Children" in avail:
        checks.append(Check("AdultMealNoChildren", "`rCSIMealAdult` > 0 AND `Sum_Children` = 0",
                            text("Adults ate less so children could eat, but the roster has no children")))
    return ModulePlan("rCSI", derived, *gen, checks)


# -- Housing --------------------------------------------------------------------

def housing(avail: set[str], p: P.Profile) -> ModulePlan:
    checks: list[Check] = []
    if "HHStatus" in avail and "HHTenureType" in avail:
        checks.append(Check(
            "DisplacedOwner", f"{R.is_in('`HHStatus`', P.HOUSING_DISPLACED)} AND `HHTenureType` = {num(P.HOUSING_OWNER)}",
            concat(text("Displaced household (status "), num_text("`HHStatus`"), text(") reports owning its dwelling")),
        ))
    return ModulePlan("Housing", {}, *_generic("Housing", P.HOUSING_SPECS, avail, p), checks)


# -- LCS ------------------------------------------------------------------------

def _used(names) -> str:
    return R.any_of([R.is_in(q(n), P.LCS_USED) for n in names])


def highest_tier_sql(avail) -> str:
    """Emergency > Crisis > Stress > No coping, by codes 20/30."""
    return (f"CASE WHEN {_used(_present(P.LCS_EMERGENCY, avail))} THEN 'Emergency' "
            f"WHEN {_used(_present(P.LCS_CRISIS, avail))} THEN 'Crisis' "
            f"WHEN {_used(_present(P.LCS_STRESS, avail))} THEN 'Stress' ELSE 'No coping' END")


def highest_tier(avail) -> Column:
    return F.expr(highest_tier_sql(avail))


def lcs(avail: set[str], p: P.Profile) -> ModulePlan:
    stress, crisis, emerg = (_present(p.lcs_tiers[x], avail) for x in ("stress", "crisis", "emergency"))
    child = _present(p.lcs_child, avail)
    all_lcs = stress + crisis + emerg
    gen = _generic("LCS", tuple(P.ColumnSpec(c, "num", choices=P.LCS_CODES) for c in all_lcs), avail, p)
    if not all_lcs:
        return ModulePlan("LCS", {}, *gen, [])
    na = num(P.LCS_NA)
    na_count = "(" + " + ".join(f"CAST({q(n)} = {na} AS INT)" for n in all_lcs) + ")"
    checks: list[Check] = []
    if child and "Sum_Children" in avail:
        checks.append(Check("ChildStratNoChildren", f"`Sum_Children` = 0 AND {_used(child)}",
                            text("A child-related coping strategy was used, but the roster has no children")))
    if "FCG" in avail:
        checks.append(Check("AllNA_PoorFood", f"{R.all_of([f'{q(n)} = {na}' for n in all_lcs])} AND `FCG` = 'Poor'",
                            text("No strategy is said to apply although food consumption is Poor")))
    if stress and crisis and emerg:
        checks.append(Check("NonSequential", f"{_used(emerg)} AND NOT ({_used(stress)} OR {_used(crisis)})",
                            text("Emergency strategy used without any stress or crisis strategy")))
    many = p.thresholds["LCS"]["many_na_count"]
    checks.append(Check("ManyNA", f"{na_count} >= {many}",
                        concat(f"CAST(coalesce({na_count}, 0) AS STRING)", text(" strategies marked not applicable"))))
    return ModulePlan("LCS", {}, *gen, checks)


# -- Expenditure (three modules) ------------------------------------------------

def expenditure(module: str):
    def build(avail: set[str], p: P.Profile) -> ModulePlan:
        t = p.thresholds[module]
        cols = _present(p.expenses[module], avail)
        missing, mm = R.missing_all(cols), text(f"Every {module} amount is missing")
        if not cols:
            return ModulePlan(module, {}, missing, mm, "0", "''", [])
        erroneous = R.erroneous_when_answered(q(f"Flag_{module}_Missing"), R.any_of([f"{q(c)} < 0" for c in cols]))
        em = concat(text("Negative amounts: "), R.name_list([(c, f"{q(c)} < 0") for c in cols]))
        checks: list[Check] = []
        if t["flag_zero_total_food"]:
            checks.append(Check("ZeroTotal", R.all_of([f"coalesce({q(c)}, 0.0D) = 0" for c in cols]),
                                text(f"Every {module} amount is zero or blank")))
        lo = t["min_item_price"]
        if lo > 0:
            small = [(c, f"({q(c)} > 0 AND {q(c)} < {num(lo)})") for c in cols]
            detail = "concat_ws(', ', " + ", ".join(
                f"CASE WHEN {R.safe(cond)} THEN concat({text(c + '=')}, format_number({q(c)}, 2)) END"
                for c, cond in small) + ")"
            checks.append(Check("BelowMinPrice", R.any_of([cond for _, cond in small]),
                                concat(text(f"Amounts above 0 but below {_fmt(lo)}: "), detail)))
        hi = t["max_single_item"]
        big = [(c, f"{q(c)} > {num(hi)}") for c in cols]
        checks.append(Check("ExtremeItem", R.any_of([cond for _, cond in big]),
                            concat(text(f"Amounts above {_fmt(hi)}: "), R.name_list(big))))
        return ModulePlan(module, {}, missing, mm, erroneous, em, checks)
    return build


# -- Timing ---------------------------------------------------------------------

def duration_minutes(start: str, end: str) -> str:
    """(end - start) in minutes, microsecond exact, for NTZ or LTZ input."""
    return f"((unix_micros(CAST({end} AS TIMESTAMP)) - unix_micros(CAST({start} AS TIMESTAMP))) / 60000000.0D)"


def local_start_hour(start: str, offset: float) -> str:
    """UTC hour (truncated) plus offset, modulo 24 with a positive result."""
    return f"pmod(CAST(hour({start}) AS DOUBLE) + {num(offset)}, 24.0D)"


def timing(avail: set[str], p: P.Profile) -> ModulePlan:
    t = p.thresholds["Timing"]
    required = [s.name for s in P.TIMING_SPECS if s.required and s.name in avail]
    missing, mm = R.missing_any(required), R.missing_text(required)
    miss = q("Flag_Timing_Missing")
    if not ("start" in avail and "end" in avail):
        return ModulePlan("Timing", {}, missing, mm, f"CASE WHEN {miss} = 0 THEN 0 END", "''", [])
    erroneous = R.erroneous_when_answered(miss, "`end` < `start`")
    em = text("Interview ends before it starts")
    dur, hour = "`Timing_Duration_Min`", "`Timing_StartHour`"
    derived = {"Timing_Duration_Min": duration_minutes("`start`", "`end`"),
               "Timing_StartHour": local_start_hour("`start`", t["utc_offset_hours"])}
    inv, short, long_ = t["invalid_duration_min"], t["short_duration_min"], t["long_duration_min"]
    early, late = t["abnormal_early_morning_end"], t["abnormal_evening_start"]
    good = f"{miss} = 0 AND `Flag_Timing_Erroneous` = 0"
    checks = [
        Check("InvalidDuration", f"{dur} <= {num(inv)}",
              concat(text("Duration "), f"format_number({dur}, 1)", text(f" min is not above {inv}"))),
        Check("ShortDuration", None,
              concat(text("Short interview: "), f"format_number({dur}, 1)", text(f" min, under {short}")),
              flag=f"CASE WHEN {good} AND {R.safe(f'{dur} > {num(inv)}')} THEN CAST({R.safe(f'{dur} < {num(short)}')} AS INT) END"),
        Check("LongDuration", f"{dur} > {num(long_)}",
              concat(text("Long interview: "), f"format_number({dur}, 1)", text(f" min, over {long_}"))),
        Check("AbnormalHour", f"({hour} < {num(early)} OR {hour} >= {num(late)})",
              concat(text("Started at local hour "), num_text(hour), text(f", outside {early}:00-{late}:00"))),
    ]
    return ModulePlan("Timing", derived, missing, mm, erroneous, em, checks)


MODULES = {
    "Demo": demo,
    "FCS": fcs,
    "HDDS": hdds,
    "rCSI": rcsi,
    "Housing": housing,
    "LCS": lcs,
    "HHExpF": expenditure("HHExpF"),
    "HHExpNF1M": expenditure("HHExpNF1M"),
    "HHExpNF6M": expenditure("HHExpNF6M"),
    "Timing": timing,
}
