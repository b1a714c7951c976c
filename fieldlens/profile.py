"""Rule profile: survey column specs, weights, codes and check thresholds.

A profile is a plain, immutable Python value on the driver.  The rule builders
compile it into literals, so Catalyst sees constants it can fold.  Threshold
layering follows standard < preset < override (B10).
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from types import MappingProxyType
from typing import Any, Callable, Mapping


@dataclass(frozen=True)
class ColumnSpec:
    """Declared type and valid range / code list of one survey column."""

    name: str
    kind: str = "num"  # num | str | datetime | date
    min: float | None = None
    max: float | None = None
    choices: tuple[float, ...] | None = None
    required: bool = True


def _num(names, lo, hi, required=True):
    return [ColumnSpec(n, "num", lo, hi, None, required) for n in names]


# ---------------------------------------------------------------------------
# Fixed values (public food-security survey methodology): column names,
# valid ranges, weights and answer codes.  They must equal the values the
# reference checks against.
# ---------------------------------------------------------------------------

CONTEXT_COLUMNS = ("_uuid", "EnuName", "EnuSupervisorName", "ADMIN1Name", "ADMIN2Name", "ADMIN3Name", "today")

DEMO_MALE = ("HHSize01M", "HHSize24M", "HHSize511M", "HHSize1217M", "HHSize1859M", "HHSize60AboveM")
DEMO_FEMALE = ("HHSize01F", "HHSize24F", "HHSize511F", "HHSize1217F", "HHSize1859F", "HHSize60AboveF")
DEMO_ADULT = ("HHSize1859M", "HHSize60AboveM", "HHSize1859F", "HHSize60AboveF")
DEMO_CHILD = ("HHSize01M", "HHSize24M", "HHSize511M", "HHSize1217M", "HHSize01F", "HHSize24F", "HHSize511F", "HHSize1217F")
DEMO_F1259 = ("HHSize1217F", "HHSize1859F")
DEMO_SPECS = tuple(
    _num(["HHSize"], 1, 99) + _num(DEMO_MALE + DEMO_FEMALE, 0, 30) + _num(["HHPregLactNb"], 0, 20, required=False)
)

FCS_WEIGHTS = {
    "FCSStap": 2, "FCSPulse": 3, "FCSDairy": 4, "FCSPr": 4,
    "FCSVeg": 1, "FCSFruit": 1, "FCSFat": 0.5, "FCSSugar": 0.5,
}
FCS_GROUPS = tuple(FCS_WEIGHTS)
FCS_SPECS = tuple(_num(FCS_GROUPS, 0, 7))

RCSI_WEIGHTS = {"rCSILessQlty": 1, "rCSIBorrow": 2, "rCSIMealSize": 1, "rCSIMealAdult": 3, "rCSIMealNb": 1}
RCSI_STRATEGIES = tuple(RCSI_WEIGHTS)
RCSI_SPECS = tuple(_num(RCSI_STRATEGIES, 0, 7))

HDDS_ALL = (
    "HDDSStapCer", "HDDSStapRoot", "HDDSPulse", "HDDSDairy", "HDDSPrMeat", "HDDSPrFish",
    "HDDSPrEggs", "HDDSVeg", "HDDSFruit", "HDDSFat", "HDDSSugar", "HDDSCond",
)
HDDS_OPTIONAL = ("HDDSStapRoot", "HDDSCond")
HDDS_SCORED = (
    "HDDSStapCer", "HDDSPulse", "HDDSDairy", "HDDSPrMeat", "HDDSPrFish",
    "HDDSPrEggs", "HDDSVeg", "HDDSFruit", "HDDSFat", "HDDSSugar",
)
HDDS_SPECS = tuple(ColumnSpec(c, "num", 0, 1, None, c not in HDDS_OPTIONAL) for c in HDDS_ALL)

HOUSING_SPECS = (
    ColumnSpec("HHStatus", "num", choices=(1, 2, 3, 4, 5, 6), required=True),
    ColumnSpec("HHTenureType", "num", choices=(1, 2, 3, 4, 5), required=False),
)
HOUSING_DISPLACED = (3, 4, 5, 6)
HOUSING_OWNER = 1

LCS_STRESS = ("Lcs_stress_DomAsset", "Lcs_stress_EatOut", "Lcs_stress_BorrowCash", "Lcs_stress_Saving")
LCS_CRISIS = ("Lcs_crisis_ProdAssets", "Lcs_crisis_OutSchool", "Lcs_crisis_Health")
LCS_EMERGENCY = ("Lcs_em_Begged", "Lcs_em_Migration", "Lcs_em_ChildWork")
LCS_CHILD = ("Lcs_em_ChildWork",)
LCS_CODES = (10, 20, 30, 9999)
LCS_NOT_NEEDED, LCS_EXHAUSTED, LCS_APPLIED, LCS_NA = 10, 20, 30, 9999
LCS_USED = (LCS_APPLIED, LCS_EXHAUSTED)
LCS_SPECS = tuple(ColumnSpec(c, "num", choices=LCS_CODES) for c in LCS_STRESS + LCS_CRISIS + LCS_EMERGENCY)

EXP_FOOD_CATEGORIES = (
    "HHExpFCer", "HHExpFTub", "HHExpFPulse", "HHExpFVeg", "HHExpFFruit", "HHExpFMeat", "HHExpFFish",
    "HHExpFDairy", "HHExpFEgg", "HHExpFOil", "HHExpFSugar", "HHExpFCond", "HHExpFBev", "HHExpFOther",
)
EXP_FOOD_SOURCES = ("_Purch_MN_7D", "_GiftAid_MN_7D", "_OwnProd_MN_7D")
EXP_NF1M_CATEGORIES = (
    "HHExpNFHyg", "HHExpNFTrans", "HHExpNFFuel", "HHExpNFWat", "HHExpNFComm", "HHExpNFMed",
    "HHExpNFEduc", "HHExpNFOther",
)
EXP_NF1M_SOURCES = ("_Purch_MN_1M", "_GiftAid_MN_1M")
EXP_NF6M_CATEGORIES = ("HHExpNFCloth", "HHExpNFRent", "HHExpNFDurable", "HHExpNFCerem", "HHExpNFDebt")
EXP_NF6M_SOURCES = ("_Purch_MN_6M", "_GiftAid_MN_6M")


def expense_columns(categories, sources) -> tuple[str, ...]:
    """Category x source expansion (B5), category-major."""
    return tuple(f"{c}{s}" for c in categories for s in sources)


EXP_COLUMNS = {
    "HHExpF": expense_columns(EXP_FOOD_CATEGORIES, EXP_FOOD_SOURCES),
    "HHExpNF1M": expense_columns(EXP_NF1M_CATEGORIES, EXP_NF1M_SOURCES),
    "HHExpNF6M": expense_columns(EXP_NF6M_CATEGORIES, EXP_NF6M_SOURCES),
}

TIMING_SPECS = (
    ColumnSpec("start", "datetime"),
    ColumnSpec("end", "datetime"),
    ColumnSpec("today", "date", required=False),
)

HHS_COLUMNS = ("HHSBedHung", "HHSNoFood", "HHSNotEat")

MODULE_ORDER = ("Demo", "FCS", "HDDS", "rCSI", "Housing", "LCS", "HHExpF", "HHExpNF1M", "HHExpNF6M", "Timing")

# Names and batch defaults of the configurable thresholds.
BATCH_THRESHOLDS: dict[str, dict[str, Any]] = {
    "Demo": {"high_hhsize_threshold": 30, "hhsize_sum_tolerance": 1},
    "FCS": {
        "low_fcs_threshold": 10, "high_fcs_threshold": 112, "low_staple_threshold": 1,
        "fcg_poor_threshold": 21, "fcg_borderline_threshold": 35,
    },
    "HDDS": {"low_hdds_threshold": 3},
    "rCSI": {"high_rcsi_with_acceptable_fcg": 18, "zero_rcsi_with_poor_fcg": True, "flag_identical": True},
    "Housing": {},
    "LCS": {"many_na_count": 3},
    "HHExpF": {"min_item_price": 0, "max_single_item": 1_000_000, "flag_zero_total_food": True},
    "HHExpNF1M": {"min_item_price": 0, "max_single_item": 1_000_000, "flag_zero_total_food": True},
    "HHExpNF6M": {"min_item_price": 0, "max_single_item": 5_000_000, "flag_zero_total_food": True},
    "Timing": {
        "invalid_duration_min": 0, "short_duration_min": 10, "long_duration_min": 120,
        "utc_offset_hours": 0, "abnormal_early_morning_end": 7, "abnormal_evening_start": 19,
    },
}

# The dashboard preset differs on three thresholds.
DASHBOARD_OVERRIDES: dict[str, dict[str, Any]] = {
    "FCS": {"high_fcs_threshold": 100, "low_staple_threshold": 2},
    "Timing": {"short_duration_min": 20},
}


def _freeze(d: Mapping[str, Mapping[str, Any]]):
    return MappingProxyType({k: MappingProxyType(dict(v)) for k, v in d.items()})


def _frozen(values: Mapping[str, Any]) -> Mapping[str, Any]:
    return field(default_factory=lambda: MappingProxyType(dict(values)))


@dataclass(frozen=True)
class Profile:
    """Everything a country can set: thresholds, module choice, weights, columns, codes and
    ranges, and modules of its own.  Layers go on top of each other: standard values,
    preset, file, single settings."""

    thresholds: Mapping[str, Mapping[str, Any]] = field(default_factory=lambda: _freeze(BATCH_THRESHOLDS))
    enabled: tuple[str, ...] = MODULE_ORDER
    name: str = "batch"
    fcs_weights: Mapping[str, float] = _frozen(FCS_WEIGHTS)
    rcsi_weights: Mapping[str, float] = _frozen(RCSI_WEIGHTS)
    expenses: Mapping[str, tuple[str, ...]] = _frozen(EXP_COLUMNS)
    lcs_tiers: Mapping[str, tuple[str, ...]] = _frozen({"stress": LCS_STRESS, "crisis": LCS_CRISIS, "emergency": LCS_EMERGENCY})
    lcs_child: tuple[str, ...] = LCS_CHILD
    #: column -> (least, largest) valid answer, instead of the declared range.
    ranges: Mapping[str, tuple[float | None, float | None]] = _frozen({})
    #: own modules: name -> builder(available columns, profile) -> ModulePlan.
    own_modules: Mapping[str, Callable] = _frozen({})

    def t(self, module: str, key: str) -> Any:
        return self.thresholds[module][key]

    @property
    def order(self) -> tuple[str, ...]:
        """Run order: the standard modules, then the own ones as they were added."""
        return MODULE_ORDER + tuple(self.own_modules)

    def specs(self, module_specs: tuple[ColumnSpec, ...]) -> tuple[ColumnSpec, ...]:
        """Column specs with this profile's ranges."""
        return tuple(replace(s, min=self.ranges[s.name][0], max=self.ranges[s.name][1]) if s.name in self.ranges else s
                     for s in module_specs)

    def fingerprint(self) -> str:
        """Hash of every value, so tables of different profiles never share a name."""
        plain = {k: (sorted((n, f"{f.__module__}.{f.__qualname__}") for n, f in v.items()) if k == "own_modules" else _plain(v))
                 for k, v in vars(self).items()}
        return hashlib.sha1(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()[:12]

    def with_overrides(self, overrides: Mapping[str, Mapping[str, Any]], name: str | None = None) -> "Profile":
        """Layer ``{module: {key: value}}`` on top; unknown keys are rejected."""
        merged = {m: dict(v) for m, v in self.thresholds.items()}
        for module, values in overrides.items():
            if module not in merged:
                raise KeyError(f"unknown module {module!r}; known: {list(merged)}")
            for key, value in values.items():
                if key not in merged[module]:
                    raise KeyError(f"unknown threshold {module}.{key}")
                merged[module][key] = value
        return replace(self, thresholds=_freeze(merged), name=name or self.name)

    def with_settings(self, settings: Mapping[str, Any], name: str | None = None) -> "Profile":
        """Layer a settings mapping (as read from a JSON file) on top.

        Keys: thresholds, fcs_weights, rcsi_weights, expenses ({module: [columns]}), lcs_tiers,
        lcs_child, ranges ({column: [least, largest]}), enabled.  Weights, tiers and expenses
        replace the standard ones of the same name; unknown keys are rejected."""
        known = {"thresholds", "fcs_weights", "rcsi_weights", "expenses", "lcs_tiers", "lcs_child", "ranges", "enabled"}
        if unknown := set(settings) - known:
            raise KeyError(f"unknown settings {sorted(unknown)}; known: {sorted(known)}")
        out = self.with_overrides(settings.get("thresholds", {}), name)
        new: dict[str, Any] = {}
        for key in ("fcs_weights", "rcsi_weights"):
            if key in settings:
                new[key] = MappingProxyType({c: float(w) for c, w in settings[key].items()})
        for key in ("expenses", "lcs_tiers"):
            if key in settings:
                if wrong := set(settings[key]) - set(getattr(out, key)):
                    raise KeyError(f"unknown {key} {sorted(wrong)}; known: {sorted(getattr(out, key))}")
                new[key] = MappingProxyType({**getattr(out, key), **{k: tuple(v) for k, v in settings[key].items()}})
        if "lcs_child" in settings:
            new["lcs_child"] = tuple(settings["lcs_child"])
        if "ranges" in settings:
            new["ranges"] = MappingProxyType({**out.ranges, **{c: (r[0], r[1]) for c, r in settings["ranges"].items()}})
        out = replace(out, **new)
        return out.select(only=settings["enabled"]) if "enabled" in settings else out

    def with_module(self, name: str, builder: Callable) -> "Profile":
        """Add an own module, run after the standard ones."""
        if name in self.order or name == "Any":
            raise KeyError(f"module {name!r} exists")
        return replace(self, own_modules=MappingProxyType({**self.own_modules, name: builder}), enabled=self.enabled + (name,))

    def select(self, only=None, skip=()) -> "Profile":
        """Module choice (B9): keep the fixed order, apply only/skip."""
        unknown = [m for m in list(only or []) + list(skip) if m not in self.order]
        if unknown:
            raise KeyError(f"unknown module(s) {unknown}; known: {list(self.order)}")
        return replace(self, enabled=tuple(m for m in self.enabled if (not only or m in only) and m not in skip))


def _plain(value: Any) -> Any:
    return {k: _plain(v) for k, v in value.items()} if isinstance(value, Mapping) else value


def parse_setting(text: str) -> dict[str, dict[str, Any]]:
    """``Module.key=value`` as an override; the value is JSON (number, true, false)."""
    path, found, value = text.partition("=")
    module, dot, key = path.strip().partition(".")
    if not (found and dot and module and key):
        raise ValueError(f"expected Module.key=value, got {text!r}")
    return {module: {key: json.loads(value)}}


def batch() -> Profile:
    return Profile()


def dashboard() -> Profile:
    return Profile().with_overrides(DASHBOARD_OVERRIDES, name="dashboard")


def fixture() -> Profile:
    """Profile of the regression anchors: batch, with a minimum item price of 5."""
    return Profile().with_overrides(
        {m: {"min_item_price": 5} for m in ("HHExpF", "HHExpNF1M", "HHExpNF6M")}, name="fixture"
    )
