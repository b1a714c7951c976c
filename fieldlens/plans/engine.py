"""``run_checks``: survey DataFrame in, flagged DataFrame out (B7-B9, C*).

The whole run is one lazy chain of five ``withColumns`` projections over the
input — no shuffle, no action — so it streams through whole-stage codegen at
any scale and works unchanged on a streaming DataFrame.  Stages:

1. derived scores of every enabled module (sums, FCS/FCG, rCSI, HDDS, timing)
2. ``Flag_<m>_Missing``            3. ``Flag_<m>_Erroneous``
4. gated specific checks           5. ``Flag_<m>_Overall`` and ``Flag_<m>_Narrative``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import profile as P
from ..functions import columns as C
from ..functions import rules as R
from ..functions.columns import col
from ..operators.checks import MODULES, ModulePlan
from ..sources.survey import coerce_types


#: 1 if any module that ran raised a flag on the row.
ANY_FLAG = "Flag_Any_Overall"


def plan_modules(columns: list[str], profile: P.Profile) -> list[ModulePlan]:
    """Build the enabled modules in dependency order from column names only."""
    avail = set(columns)
    plans = []
    for name in profile.order:
        if name not in profile.enabled:
            continue
        plan = (profile.own_modules.get(name) or MODULES[name])(avail, profile)
        plans.append(plan)
        avail |= set(plan.derived)
    return plans


def _produced_names(plans: list[ModulePlan]) -> list[str]:
    names = []
    for p in plans:
        names += list(p.derived) + p.flag_columns + [p.flag("Overall"), p.flag("Narrative")]
    return names + [ANY_FLAG]


def run_checks(survey: DataFrame, profile: P.Profile | None = None, only=None, skip=(), coerce: bool = True) -> DataFrame:
    """Apply every enabled module; returns the input plus derived and flag columns.

    An input column whose name the engine produces (e.g. a raw ``FCS``) is kept
    as ``<name>_input``; the computed value wins.
    """
    profile = (profile or P.batch()).select(only, skip)
    df = coerce_types(survey) if coerce else survey
    # Plan on the raw columns; if an input clashes with a produced name, move it
    # out of the way and plan again (rare).
    plans = plan_modules(df.columns, profile)
    clashes = [n for n in _produced_names(plans) if n in df.columns]
    if clashes:
        df = df.withColumnsRenamed({n: f"{n}_input" for n in clashes})
        plans = plan_modules(df.columns, profile)

    def stage(frame: DataFrame, exprs: dict[str, str]) -> DataFrame:
        # one F.expr per output column: a single JVM call each
        return frame.withColumns({k: F.expr(v) for k, v in exprs.items()}) if exprs else frame

    derived: dict[str, str] = {}
    for p in plans:
        derived.update(p.derived)
    df = stage(df, derived)
    df = stage(df, {p.missing_col: p.missing for p in plans})
    df = stage(df, {p.erroneous_col: p.erroneous for p in plans})

    checks: dict[str, str] = {}
    for p in plans:
        m, e = R.q(p.missing_col), R.q(p.erroneous_col)
        for c in p.checks:
            checks[p.flag(c.name)] = c.flag if c.flag is not None else R.gate(c.cond, m, e)
    df = stage(df, checks)

    final: dict[str, str] = {}
    for p in plans:
        final[p.flag("Overall")] = R.rollup([R.q(f) for f in p.flag_columns])
        parts = [(R.q(p.missing_col), p.missing_msg), (R.q(p.erroneous_col), p.erroneous_msg)]
        for c in p.checks:
            parts.append((R.q(p.flag(c.name)), c.message))
            parts += [(R.q(p.flag(c.name)), d) for d in c.details]
        final[p.flag("Narrative")] = R.narrative(parts)
    # Stored once, so that readers of the flagged table can push the filter to Parquet.
    overall = [f"coalesce({R.q(p.flag('Overall'))}, 0)" for p in plans]
    df = stage(df, final)
    return stage(df, {ANY_FLAG: f"CAST(greatest({', '.join(overall + ['0', '0'][:max(0, 2 - len(overall))])}) AS INT)"})


def module_flag_columns(flagged: DataFrame, module: str) -> list[str]:
    """Check columns of a module, found by name (Overall/Narrative excluded)."""
    prefix = f"Flag_{module}_"
    return [c for c in flagged.columns
            if c.startswith(prefix) and c not in (f"{prefix}Overall", f"{prefix}Narrative")]


def modules_in(flagged: DataFrame) -> list[str]:
    """Modules that ran, in run order (their Overall column exists); own modules last."""
    ran = [c[5:-8] for c in flagged.columns if c.startswith("Flag_") and c.endswith("_Overall") and c != ANY_FLAG]
    return [m for m in P.MODULE_ORDER if m in ran] + [m for m in ran if m not in P.MODULE_ORDER]


# Derived columns each module shows in its own view.
OUTPUT_DERIVED = {
    "FCS": ("FCS", "FCG"), "rCSI": ("rCSI",), "HDDS": ("HDDS",),
    "Timing": ("Timing_Duration_Min", "Timing_StartHour"),
}


def module_view(flagged: DataFrame, module: str, profile: P.Profile | None = None) -> DataFrame:
    """Context + derived + flag columns of one module, de-duplicated, in order."""
    context = [c for c in ("row_seq",) + P.CONTEXT_COLUMNS if c in flagged.columns]
    derived = [c for c in OUTPUT_DERIVED.get(module, ()) if c in flagged.columns]
    flags = module_flag_columns(flagged, module) + [f"Flag_{module}_Overall", f"Flag_{module}_Narrative"]
    ordered = list(dict.fromkeys(context + derived + flags))
    return flagged.select(*[col(c) for c in ordered])


def any_flag(flagged: DataFrame) -> Column:
    """1 if any module raised a flag on the row."""
    if ANY_FLAG in flagged.columns:
        return col(ANY_FLAG)
    return C.rollup([col(f"Flag_{m}_Overall") for m in modules_in(flagged)])
