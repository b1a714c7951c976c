"""DuckDB oracle SQL for the registered queries.

The flagged table is re-stated here in plain SQL, written separately from the
Spark expression builders: same rules, different code.  Thresholds are those
of the ``fixture`` profile (batch defaults, minimum item price 5).
"""

from __future__ import annotations

from ..sources.fixture import SURVEY_COLUMNS, survey_sql
from ..sources.survey import declared_specs

# Column groups of the derived survey (those present in it).
DEMO_M = ["HHSize01M", "HHSize24M", "HHSize511M", "HHSize1217M", "HHSize1859M", "HHSize60AboveM"]
DEMO_F = ["HHSize01F", "HHSize24F", "HHSize511F", "HHSize1217F", "HHSize1859F", "HHSize60AboveF"]
DEMO_ADULT = ["HHSize1859M", "HHSize60AboveM", "HHSize1859F", "HHSize60AboveF"]
DEMO_CHILD = ["HHSize01M", "HHSize24M", "HHSize511M", "HHSize1217M", "HHSize01F", "HHSize24F", "HHSize511F", "HHSize1217F"]
FCS_W = [("FCSStap", 2), ("FCSPulse", 3), ("FCSDairy", 4), ("FCSPr", 4), ("FCSVeg", 1), ("FCSFruit", 1),
         ("FCSFat", 0.5), ("FCSSugar", 0.5)]
RCSI_W = [("rCSILessQlty", 1), ("rCSIBorrow", 2), ("rCSIMealSize", 1), ("rCSIMealAdult", 3), ("rCSIMealNb", 1)]
HDDS = ["HDDSStapCer", "HDDSPulse", "HDDSDairy", "HDDSPrMeat", "HDDSPrFish", "HDDSPrEggs", "HDDSVeg", "HDDSFruit",
        "HDDSFat", "HDDSSugar"]
LCS_S = ["Lcs_stress_DomAsset", "Lcs_stress_EatOut", "Lcs_stress_BorrowCash", "Lcs_stress_Saving"]
LCS_C = ["Lcs_crisis_ProdAssets", "Lcs_crisis_OutSchool", "Lcs_crisis_Health"]
LCS_E = ["Lcs_em_Begged", "Lcs_em_Migration", "Lcs_em_ChildWork"]
LCS = LCS_S + LCS_C + LCS_E
EXP = {
    "HHExpF": (["HHExpFCer_Purch_MN_7D", "HHExpFCer_OwnProd_MN_7D", "HHExpFPulse_Purch_MN_7D",
                "HHExpFPulse_OwnProd_MN_7D", "HHExpFOil_Purch_MN_7D", "HHExpFOil_OwnProd_MN_7D"], 1000000),
    "HHExpNF1M": (["HHExpNFHyg_Purch_MN_1M", "HHExpNFWat_Purch_MN_1M"], 1000000),
    "HHExpNF6M": (["HHExpNFCloth_Purch_MN_6M", "HHExpNFRent_Purch_MN_6M"], 5000000),
}
MIN_PRICE = 5

# Check columns per module, in evaluation order.
CHECKS = {
    "Demo": ["Missing", "Erroneous", "HighHHSize", "SumMismatch", "NoAdults", "PLWExceeds"],
    "FCS": ["Missing", "Erroneous", "Identical", "LowStaple", "Low", "High"],
    "HDDS": ["Missing", "Erroneous", "Low", "AllGroups"],
    "rCSI": ["Missing", "Erroneous", "Identical", "ZeroWithPoorFCG", "HighWithAcceptFCG", "AdultMealNoChildren"],
    "Housing": ["Missing", "Erroneous", "DisplacedOwner"],
    "LCS": ["Missing", "Erroneous", "ChildStratNoChildren", "AllNA_PoorFood", "NonSequential", "ManyNA"],
    "HHExpF": ["Missing", "Erroneous", "ZeroTotal", "BelowMinPrice", "ExtremeItem"],
    "HHExpNF1M": ["Missing", "Erroneous", "ZeroTotal", "BelowMinPrice", "ExtremeItem"],
    "HHExpNF6M": ["Missing", "Erroneous", "ZeroTotal", "BelowMinPrice", "ExtremeItem"],
    "Timing": ["Missing", "Erroneous", "InvalidDuration", "ShortDuration", "LongDuration", "AbnormalHour"],
}
MODULES = list(CHECKS)


def _q(c: str) -> str:
    return f'"{c}"'


def _or(parts) -> str:
    return "(" + " OR ".join(parts) + ")"


def _and(parts) -> str:
    return "(" + " AND ".join(parts) + ")"


def _sum0(cols) -> str:
    return "(" + " + ".join(f"coalesce({_q(c)}, 0)" for c in cols) + ")"


def _flag(cond: str) -> str:
    return f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS INTEGER)"


def _gated(m: str, cond: str) -> str:
    return (f"CAST(CASE WHEN Flag_{m}_Missing = 0 AND Flag_{m}_Erroneous = 0 "
            f"THEN CASE WHEN {cond} THEN 1 ELSE 0 END END AS INTEGER)")


def _err(m: str, cond: str) -> str:
    return f"CAST(CASE WHEN Flag_{m}_Missing = 0 THEN CASE WHEN {cond} THEN 1 ELSE 0 END END AS INTEGER)"


def _range(cols, lo, hi) -> list[str]:
    return [f"{_q(c)} < {lo} OR {_q(c)} > {hi}" for c in cols]


def _used(cols) -> str:
    return _or([f"{_q(c)} IN (20, 30)" for c in cols])


def _flagged_cte(fcs_high: int = 112, staple: int = 1, short: int = 10, weights=FCS_W, poor: int = 21, borderline: int = 35) -> str:
    derived = ",\n    ".join([
        f"{_sum0(DEMO_M)} AS Sum_M", f"{_sum0(DEMO_F)} AS Sum_F", f"{_sum0(DEMO_M + DEMO_F)} AS Sum_All",
        f"{_sum0(DEMO_ADULT)} AS Sum_Adults", f"{_sum0(DEMO_CHILD)} AS Sum_Children",
        f"{_sum0(['HHSize1217F', 'HHSize1859F'])} AS Sum_F1259",
        "(" + " + ".join(f"{_q(c)} * {w}" for c, w in weights) + ") AS FCS",
        "(" + " + ".join(f"{_q(c)} * {w}" for c, w in RCSI_W) + ") AS rCSI",
        f"CAST({_sum0(HDDS)} AS DOUBLE) AS HDDS",
        '(epoch_us("end") - epoch_us("start")) / 60000000.0 AS Timing_Duration_Min',
        'CAST(hour("start") AS DOUBLE) AS Timing_StartHour',
    ])
    fcs_cols = [c for c, _ in FCS_W]
    rcsi_cols = [c for c, _ in RCSI_W]
    missing = ",\n    ".join([
        f"{_flag(_or([f'{_q(c)} IS NULL' for c in ['HHSize'] + DEMO_M + DEMO_F]))} AS Flag_Demo_Missing",
        f"{_flag(_or([f'{_q(c)} IS NULL' for c in fcs_cols]))} AS Flag_FCS_Missing",
        f"{_flag(_or([f'{_q(c)} IS NULL' for c in HDDS]))} AS Flag_HDDS_Missing",
        f"{_flag(_or([f'{_q(c)} IS NULL' for c in rcsi_cols]))} AS Flag_rCSI_Missing",
        f"{_flag('HHStatus IS NULL')} AS Flag_Housing_Missing",
        f"{_flag(_or([f'{_q(c)} IS NULL' for c in LCS]))} AS Flag_LCS_Missing",
        *[f"{_flag(_and([f'{_q(c)} IS NULL' for c in cols]))} AS Flag_{m}_Missing" for m, (cols, _) in EXP.items()],
        f"{_flag(_or(['\"start\" IS NULL', '\"end\" IS NULL']))} AS Flag_Timing_Missing",
    ])
    erroneous = ",\n    ".join([
        f"{_err('Demo', _or(_range(['HHSize'], 1, 99) + _range(DEMO_M + DEMO_F, 0, 30) + _range(['HHPregLactNb'], 0, 20)))}"
        " AS Flag_Demo_Erroneous",
        f"{_err('FCS', _or(_range(fcs_cols, 0, 7)))} AS Flag_FCS_Erroneous",
        f"{_err('HDDS', _or(_range(HDDS, 0, 1)))} AS Flag_HDDS_Erroneous",
        f"{_err('rCSI', _or(_range(rcsi_cols, 0, 7)))} AS Flag_rCSI_Erroneous",
        f"{_err('Housing', _or(['(HHStatus IS NOT NULL AND HHStatus NOT IN (1, 2, 3, 4, 5, 6))', '(HHTenureType IS NOT NULL AND HHTenureType NOT IN (1, 2, 3, 4, 5))']))}"
        " AS Flag_Housing_Erroneous",
        f"{_err('LCS', _or([f'({_q(c)} IS NOT NULL AND {_q(c)} NOT IN (10, 20, 30, 9999))' for c in LCS]))}"
        " AS Flag_LCS_Erroneous",
        *[f"{_err(m, _or([f'{_q(c)} < 0' for c in cols]))} AS Flag_{m}_Erroneous" for m, (cols, _) in EXP.items()],
        f"{_err('Timing', '\"end\" < \"start\"')} AS Flag_Timing_Erroneous",
    ])
    g = ", ".join(_q(c) for c in fcs_cols)
    r = ", ".join(_q(c) for c in rcsi_cols)
    na_count = "(" + " + ".join(f"CASE WHEN {_q(c)} = 9999 THEN 1 ELSE 0 END" for c in LCS) + ")"
    checks = [
        ("Demo", "HighHHSize", "HHSize > 30"),
        ("Demo", "SumMismatch", "abs(Sum_All - HHSize) > 1"),
        ("Demo", "NoAdults", "Sum_Adults = 0"),
        ("Demo", "PLWExceeds", "HHPregLactNb > Sum_F1259"),
        ("FCS", "Identical", f"greatest({g}) = least({g}) AND FCSStap <> 0"),
        ("FCS", "LowStaple", f"FCSStap < {staple}"),
        ("FCS", "Low", "FCS < 10"),
        ("FCS", "High", f"FCS > {fcs_high}"),
        ("HDDS", "Low", "HDDS < 3"),
        ("HDDS", "AllGroups", f"HDDS = {len(HDDS)}"),
        ("rCSI", "Identical", f"greatest({r}) = least({r}) AND rCSILessQlty <> 0"),
        ("rCSI", "ZeroWithPoorFCG", "FCG = 'Poor' AND rCSI = 0"),
        ("rCSI", "HighWithAcceptFCG", "FCG = 'Acceptable' AND rCSI > 18"),
        ("rCSI", "AdultMealNoChildren", "rCSIMealAdult > 0 AND Sum_Children = 0"),
        ("Housing", "DisplacedOwner", "HHStatus IN (3, 4, 5, 6) AND HHTenureType = 1"),
        ("LCS", "ChildStratNoChildren", "Sum_Children = 0 AND Lcs_em_ChildWork IN (20, 30)"),
        ("LCS", "AllNA_PoorFood", _and([f"{_q(c)} = 9999" for c in LCS]) + " AND FCG = 'Poor'"),
        ("LCS", "NonSequential", f"{_used(LCS_E)} AND NOT ({_used(LCS_S)} OR {_used(LCS_C)})"),
        ("LCS", "ManyNA", f"{na_count} >= 3"),
    ]
    for m, (cols, hi) in EXP.items():
        checks += [
            (m, "ZeroTotal", _and([f"coalesce({_q(c)}, 0) = 0" for c in cols])),
            (m, "BelowMinPrice", _or([f"({_q(c)} > 0 AND {_q(c)} < {MIN_PRICE})" for c in cols])),
            (m, "ExtremeItem", _or([f"{_q(c)} > {hi}" for c in cols])),
        ]
    checks += [
        ("Timing", "InvalidDuration", "Timing_Duration_Min <= 0"),
        ("Timing", "LongDuration", "Timing_Duration_Min > 120"),
        ("Timing", "AbnormalHour", "Timing_StartHour < 7 OR Timing_StartHour >= 19"),
    ]
    check_sql = [f"{_gated(m, c)} AS Flag_{m}_{n}" for m, n, c in checks]
    check_sql.append(
        "CAST(CASE WHEN Flag_Timing_Missing = 0 AND Flag_Timing_Erroneous = 0 AND Timing_Duration_Min > 0 "
        f"THEN CASE WHEN Timing_Duration_Min < {short} THEN 1 ELSE 0 END END AS INTEGER) AS Flag_Timing_ShortDuration")
    overall = [
        f"CAST(greatest({', '.join(f'coalesce(Flag_{m}_{c}, 0)' for c in cs)}) AS INTEGER) AS Flag_{m}_Overall"
        for m, cs in CHECKS.items()
    ]
    return (
        f"s AS ({survey_sql()}),\n"
        f"d AS (SELECT *,\n    {derived}\n  FROM s),\n"
        f"d2 AS (SELECT *, CASE WHEN FCS < {poor} THEN 'Poor' WHEN FCS < {borderline} THEN 'Borderline' "
        f"WHEN FCS >= {borderline} THEN 'Acceptable' END AS FCG FROM d),\n"
        f"m AS (SELECT *,\n    {missing}\n  FROM d2),\n"
        f"e AS (SELECT *,\n    {erroneous}\n  FROM m),\n"
        f"c AS (SELECT *,\n    {', '.join(check_sql)}\n  FROM e),\n"
        f"flagged AS (SELECT *,\n    {', '.join(overall)}\n  FROM c)"
    )


FLAGGED = _flagged_cte()


def _with(body: str, cte: str = FLAGGED) -> str:
    return f"WITH {cte}\n{body}"


def _any_flag() -> str:
    return "greatest(" + ", ".join(f"Flag_{m}_Overall" for m in MODULES) + ")"


DERIVED_VIEW = {"FCS": ["FCS", "FCG"], "rCSI": ["rCSI"], "HDDS": ["HDDS"],
                "Timing": ["Timing_Duration_Min", "Timing_StartHour"]}


def _module_flags(m: str) -> str:
    cols = [_q(c) for c in ["row_seq", "_uuid"] + DERIVED_VIEW.get(m, [])]
    cols += [f"CAST(Flag_{m}_{c} AS DOUBLE) AS Flag_{m}_{c}" for c in CHECKS[m] + ["Overall"]]
    return _with(f"SELECT {', '.join(cols)} FROM flagged")


def _pct(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100.0"


def _check_list():
    out = []
    for m, cs in CHECKS.items():
        for c in cs:
            out.append((m, c))
    return out


def _check_counts_body() -> str:
    parts = [f"SELECT '{m}' AS module, '{c}' AS \"check\", count(*) FILTER (WHERE Flag_{m}_{c} = 1) AS n_flagged, "
             f"CAST({i} AS INTEGER) AS check_pos FROM flagged" for i, (m, c) in enumerate(_check_list())]
    return " UNION ALL ".join(parts)


def _rate_band_report(r: str) -> str:
    return f"CASE WHEN {r} > 20 THEN 'Critical' WHEN {r} > 10 THEN 'High' WHEN {r} > 0 THEN 'Medium' ELSE 'OK' END"


def _flag_rate_by(key: str, out: str) -> str:
    return _with(f"""
, pairs AS (
  SELECT _uuid AS _id, {key} AS _g, count(*) AS _n, max({_any_flag()}) AS _f FROM flagged GROUP BY 1, 2),
idf AS (SELECT _id, max(_f) AS _idf FROM pairs GROUP BY 1),
agg AS (
  SELECT p._g AS {out}, sum(p._n) AS surveys,
         count(*) FILTER (WHERE i._idf = 1 AND p._id IS NOT NULL) AS flagged
  FROM pairs p JOIN idf i ON p._id IS NOT DISTINCT FROM i._id WHERE p._g IS NOT NULL GROUP BY 1)
SELECT {out}, CAST(surveys AS BIGINT) AS surveys, flagged, {_pct('flagged', 'surveys')} AS rate_pct,
  {_rate_band_report(_pct('flagged', 'surveys'))} AS rate_band,
  {_pct('surveys', 'sum(surveys) OVER ()')} AS survey_share_pct
FROM agg""".replace("\n, pairs", ", pairs", 1))


RCSI_BAND = "CASE WHEN rCSI <= 3 THEN 'Low' WHEN rCSI >= 4 AND rCSI <= 18 THEN 'Medium' WHEN rCSI >= 19 THEN 'High' END"
HDDS_BAND = "CASE WHEN HDDS <= 3 THEN 'Low' WHEN HDDS >= 4 AND HDDS <= 6 THEN 'Medium' WHEN HDDS >= 7 THEN 'High' END"
TIER = (f"CASE WHEN {_used(LCS_E)} THEN 'Emergency' WHEN {_used(LCS_C)} THEN 'Crisis' "
        f"WHEN {_used(LCS_S)} THEN 'Stress' ELSE 'No coping' END")
STRAIGHT = ("((" + " + ".join(f"CASE WHEN {_q(c)} IS NOT NULL THEN 1 ELSE 0 END" for c, _ in FCS_W) + ") >= 2 AND "
            f"greatest({', '.join(_q(c) for c, _ in FCS_W)}) = least({', '.join(_q(c) for c, _ in FCS_W)}))")
SEVERITY_D8 = ("CASE WHEN rCSI > -1 AND rCSI <= 3 THEN 'Low' WHEN rCSI > 3 AND rCSI <= 18 THEN 'Medium' "
               "WHEN rCSI > 18 AND rCSI <= 9999 THEN 'High' END")
HHS_BAND = ("CASE WHEN h > -1 AND h <= 0 THEN '0' WHEN h > 0 AND h <= 1 THEN '1' WHEN h > 1 AND h <= 3 THEN '2-3' "
            "WHEN h > 3 AND h <= 4 THEN '4' WHEN h > 4 AND h <= 6 THEN '5-6' END")
RCSI_MX = "CASE WHEN rCSI > -1 AND rCSI <= 3 THEN '<4' WHEN rCSI > 3 AND rCSI <= 18 THEN '4-18' WHEN rCSI > 18 AND rCSI <= 56 THEN '>18' END"
TARGET = 12000


def _tier_of(c: str) -> str:
    return "Stress" if c in LCS_S else "Crisis" if c in LCS_C else "Emergency"


def _share(group: str, band: str, labels) -> str:
    parts = " UNION ALL ".join(
        f"SELECT g AS \"group\", n_group, '{lab}' AS label, CAST({i} AS INTEGER) AS label_pos, c{i} AS n FROM w"
        for i, lab in enumerate(labels))
    counts = ", ".join(f"count(*) FILTER (WHERE b = '{lab}') AS c{i}" for i, lab in enumerate(labels))
    return _with(f""", base AS (SELECT {group} AS g, {band} AS b FROM flagged),
w AS (SELECT g, count(*) AS n_group, {counts} FROM base WHERE g IS NOT NULL AND b IS NOT NULL GROUP BY g),
t AS ({parts})
SELECT "group", n_group, label, label_pos, n, {_pct('n', 'n_group')} AS pct FROM t""")


def _five(group: str, value: str) -> str:
    return f"""SELECT {group} AS "group", count(*) AS n, min({value}) AS min,
  quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3,
  max({value}) AS max,
  quantile_cont({value}, 0.25) - 1.5 * (quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)) AS lower_fence,
  quantile_cont({value}, 0.75) + 1.5 * (quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)) AS upper_fence
FROM flagged WHERE {group} IS NOT NULL AND {value} IS NOT NULL GROUP BY 1"""


def _queries() -> dict[str, str]:
    q: dict[str, str] = {}
    for m in MODULES:
        q[f"{m.lower()}_flags"] = _module_flags(m)
    dash = _flagged_cte(fcs_high=100, staple=2, short=20)
    q["fcs_flags_dashboard"] = _with(
        "SELECT _uuid, row_seq, FCS, FCG, " + ", ".join(f"CAST(Flag_FCS_{c} AS DOUBLE) AS Flag_FCS_{c}" for c in
        ["Missing", "Erroneous", "Identical", "LowStaple", "Low", "High", "Overall"]) + " FROM flagged", dash)
    own = _flagged_cte(weights=[(c, {"FCSSugar": 0.25, "FCSPr": 3.5}.get(c, w)) for c, w in FCS_W], poor=28, borderline=42)
    q["fcs_own_weights"] = _with(
        "SELECT _uuid, row_seq, FCS, FCG, " + ", ".join(f"CAST(Flag_{f} AS DOUBLE) AS Flag_{f}" for f in
        ["FCS_Low", "FCS_High", "FCS_Overall", "rCSI_ZeroWithPoorFCG", "rCSI_HighWithAcceptFCG"]) + " FROM flagged", own)
    q["check_counts"] = _with(_check_counts_body())
    q["fcs_summary"] = _with(f"SELECT * FROM ({_check_counts_body()}) t WHERE module = 'FCS'")
    q["top_checks"] = _with(f"SELECT * FROM ({_check_counts_body()}) t WHERE n_flagged > 0")
    q["module_summary"] = _with(" UNION ALL ".join(
        f"SELECT '{m}' AS module, count(*) AS total_records, count(*) FILTER (WHERE Flag_{m}_Overall = 1) AS flagged_records, "
        f"{_pct(f'count(*) FILTER (WHERE Flag_{m}_Overall = 1)', 'count(*)')} AS flag_rate_pct, "
        f"CASE WHEN {_pct(f'count(*) FILTER (WHERE Flag_{m}_Overall = 1)', 'count(*)')} > 20 THEN 'high' "
        f"WHEN {_pct(f'count(*) FILTER (WHERE Flag_{m}_Overall = 1)', 'count(*)')} > 10 THEN 'medium' "
        f"WHEN {_pct(f'count(*) FILTER (WHERE Flag_{m}_Overall = 1)', 'count(*)')} > 5 THEN 'low' ELSE 'ok' END AS rate_band "
        "FROM flagged" for m in MODULES))
    q["flagged_ids"] = _with(
        f"SELECT n_rows, total_flagged_ids, {_pct('total_flagged_ids', 'n_rows')} AS overall_rate_pct FROM ("
        f"SELECT count(*) AS n_rows, count(DISTINCT CASE WHEN {_any_flag()} = 1 THEN _uuid END) AS total_flagged_ids "
        "FROM flagged) t")
    q["flag_rate_by_enumerator"] = _flag_rate_by("EnuName", "enumerator")
    q["flag_rate_by_area"] = _flag_rate_by("ADMIN1Name", "area")
    q["top_enumerators"] = _flag_rate_by("EnuName", "enumerator") + " ORDER BY round_even(rate_pct, 1) DESC, enumerator LIMIT 20"
    q["survey_header"] = _with("""SELECT n, CAST(CAST(lo AS DATE) AS VARCHAR) AS date_min, CAST(CAST(hi AS DATE) AS VARCHAR) AS date_max,
  CAST(coalesce(floor((epoch(hi) - epoch(lo)) / 86400) + 1, 0) AS BIGINT) AS days_active,
  n_enumerators, n_areas, CAST(n AS DOUBLE) / CAST(greatest(n_enumerators, 1) AS DOUBLE) AS surveys_per_enumerator
FROM (SELECT count(*) AS n, min(CAST(today AS TIMESTAMP)) AS lo, max(CAST(today AS TIMESTAMP)) AS hi,
  count(DISTINCT EnuName) AS n_enumerators, count(DISTINCT ADMIN1Name) AS n_areas FROM flagged) t""")
    q["daily_counts_cumulative"] = _with(f"""SELECT CAST(date AS VARCHAR) AS date, n, CAST(sum(n) OVER (ORDER BY date) AS BIGINT) AS cumulative,
  CAST({TARGET} AS DOUBLE) / count(*) OVER () * row_number() OVER (ORDER BY date) AS expected
FROM (SELECT today AS date, count(*) AS n FROM flagged WHERE today IS NOT NULL GROUP BY 1) t""")
    q["fcg_dist"] = _with(" UNION ALL ".join(
        f"SELECT '{lab}' AS label, CAST({i} AS INTEGER) AS label_pos, count(*) FILTER (WHERE FCG = '{lab}') AS n, "
        f"{_pct(f'count(*) FILTER (WHERE FCG = {chr(39)}{lab}{chr(39)})', 'count(*)')} AS pct_all, "
        f"{_pct(f'count(*) FILTER (WHERE FCG = {chr(39)}{lab}{chr(39)})', 'count(FCG)')} AS pct_classified FROM flagged"
        for i, lab in enumerate(["Poor", "Borderline", "Acceptable"])))
    for name, band, den in (("rcsi_dist", RCSI_BAND, "count(rCSI)"), ("hdds_dist", HDDS_BAND, "count(HDDS)")):
        q[name] = _with(" UNION ALL ".join(
            f"SELECT '{lab}' AS label, CAST({i} AS INTEGER) AS label_pos, count(*) FILTER (WHERE {band} = '{lab}') AS n, "
            f"{_pct(f'count(*) FILTER (WHERE {band} = {chr(39)}{lab}{chr(39)})', den)} AS pct_scored FROM flagged"
            for i, lab in enumerate(["Low", "Medium", "High"])))
    q["lcs_tier_dist"] = _with(" UNION ALL ".join(
        f"SELECT '{lab}' AS label, CAST({i} AS INTEGER) AS label_pos, count(*) FILTER (WHERE {TIER} = '{lab}') AS n, "
        f"{_pct(f'count(*) FILTER (WHERE {TIER} = {chr(39)}{lab}{chr(39)})', 'count(*)')} AS pct_all FROM flagged"
        for i, lab in enumerate(["No coping", "Stress", "Crisis", "Emergency"])))
    q["score_means"] = _with("SELECT avg(FCS) AS mean_fcs, avg(rCSI) AS mean_rcsi, avg(HDDS) AS mean_hdds FROM flagged")
    q["duration_stats"] = _with("SELECT avg(Timing_Duration_Min) AS mean_minutes, "
                                "quantile_cont(Timing_Duration_Min, 0.5) AS median_minutes, "
                                "count(Timing_Duration_Min) AS n_timed FROM flagged")
    q["surveys_by_area"] = _with("SELECT ADMIN2Name AS area, count(*) AS surveys FROM flagged "
                                 "WHERE ADMIN2Name IS NOT NULL GROUP BY 1")
    q["duplicate_ids"] = _with("SELECT _uuid AS id, count(*) AS n_rows FROM flagged WHERE _uuid IS NOT NULL "
                               "GROUP BY 1 HAVING count(*) > 1")
    q["duplicate_rows"] = _with("SELECT _uuid, EnuName, ADMIN2Name, CAST(today AS VARCHAR) AS today, HHSize, HHStatus, FCS, FCG, rCSI, "
                                "Timing_Duration_Min, row_seq FROM flagged WHERE _uuid IN "
                                "(SELECT _uuid FROM flagged WHERE _uuid IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
    q["straight_lining"] = _with(f"SELECT EnuName AS enumerator, count(*) AS straight_line FROM flagged "
                                 f"WHERE EnuName IS NOT NULL AND {STRAIGHT} GROUP BY 1")
    miss = ("(avg(CASE WHEN FCSStap IS NULL THEN 1 ELSE 0 END) + avg(CASE WHEN rCSILessQlty IS NULL THEN 1 ELSE 0 END) "
            "+ avg(CASE WHEN HHSize IS NULL THEN 1 ELSE 0 END)) / 3.0 * 100.0")
    q["missing_pct_by_enumerator"] = _with(f"SELECT EnuName AS enumerator, {miss} AS missing_pct FROM flagged "
                                           "WHERE EnuName IS NOT NULL GROUP BY 1")
    q["valid_duration_by_enumerator"] = _with(
        "SELECT EnuName AS enumerator, avg(Timing_Duration_Min) AS avg_duration_min, count(*) AS n_valid FROM flagged "
        "WHERE EnuName IS NOT NULL AND Timing_Duration_Min > 0 AND Timing_Duration_Min < 300 GROUP BY 1")
    rate_sql = _flag_rate_by("EnuName", "enumerator")
    q["enumerator_scorecard"] = rate_sql.replace(
        "\nSELECT enumerator, CAST(surveys AS BIGINT) AS surveys",
        f""",
extra AS (SELECT EnuName AS enumerator, {miss} AS missing_pct,
  avg(CASE WHEN Timing_Duration_Min > 0 AND Timing_Duration_Min < 300 THEN Timing_Duration_Min END) AS avg_duration_min,
  arg_min(EnuSupervisorName, CASE WHEN EnuSupervisorName IS NOT NULL THEN row_seq END) AS supervisor,
  CASE WHEN count(*) FILTER (WHERE {STRAIGHT}) > 0 THEN count(*) FILTER (WHERE {STRAIGHT}) END AS straight_line
  FROM flagged WHERE EnuName IS NOT NULL GROUP BY 1),
r AS (SELECT enumerator, CAST(surveys AS BIGINT) AS surveys""", 1).replace(
        "\nFROM agg", "\nFROM agg)\nSELECT r.enumerator, surveys, flagged, rate_pct, missing_pct, avg_duration_min, "
        "supervisor, CAST(straight_line AS DOUBLE) AS straight_line FROM r LEFT JOIN extra x ON r.enumerator = x.enumerator", 1)
    metrics = [("FCS", "FCS"), ("rCSI", "rCSI"), ("HDDS", "HDDS"), ("HHSize", "HHSize"), ("Duration", "Timing_Duration_Min")]
    # Sums are taken as decimals, so that no order of addition shows in the last digits.
    s, n = "CAST(sum(CAST({c} AS DECIMAL(20, 9))) AS DOUBLE)", "CAST(count({c}) AS DOUBLE)"
    q2 = "CAST(sum(CAST({c} * {c} AS DECIMAL(28, 9))) AS DOUBLE)"
    mean = f"{s} / nullif({n}, 0)"
    sd = f"CASE WHEN count({{c}}) > 1 THEN sqrt(greatest(({q2} - {s} * {s} / {n}) / ({n} - 1), 0)) END"
    g = ", ".join(f"{mean.format(c=c)} AS m_{k}" for k, c in metrics)
    o = ", ".join(f"{mean.format(c=c)} AS o_{k}, {sd.format(c=c)} AS d_{k}" for k, c in metrics)
    long = " UNION ALL ".join(
        f"SELECT enumerator, '{k}' AS metric, m_{k} AS mean, o_{k} AS overall_mean, d_{k} AS overall_sd FROM g, o"
        for k, _ in metrics)
    q["enumerator_deviation"] = _with(f""", g AS (SELECT EnuName AS enumerator, {g} FROM flagged WHERE EnuName IS NOT NULL GROUP BY 1),
o AS (SELECT {o} FROM flagged),
l AS ({long})
SELECT enumerator, metric, mean, overall_mean, overall_sd,
  coalesce(overall_sd <> 0 AND mean IS NOT NULL AND abs(round_even(mean, 2) - overall_mean) > 1.5 * overall_sd, false) AS deviates
FROM l""")
    q["submission_matrix"] = _with("SELECT EnuName AS enumerator, CAST(today AS VARCHAR) AS date, count(*) AS n FROM flagged "
                                   "WHERE EnuName IS NOT NULL AND today IS NOT NULL GROUP BY 1, 2")
    q["fcg_share_by_area"] = _share("ADMIN2Name", "FCG", ["Poor", "Borderline", "Acceptable"])
    q["rcsi_share_by_enumerator"] = _share("EnuName", SEVERITY_D8, ["Low", "Medium", "High"])
    q["fcg_share_top_areas"] = _share("ADMIN2Name", "FCG", ["Poor", "Borderline", "Acceptable"]) + (
        ' WHERE "group" IN (SELECT ADMIN2Name FROM flagged WHERE ADMIN2Name IS NOT NULL GROUP BY 1 '
        "ORDER BY count(*) DESC, ADMIN2Name LIMIT 3)")
    q["fcg_share_by_enumerator"] = _share("EnuName", "FCG", ["Poor", "Borderline", "Acceptable"])
    q["rcsi_share_by_area"] = _share("ADMIN2Name", SEVERITY_D8, ["Low", "Medium", "High"])
    q["behaviour_totals"] = _with(f""", b AS (SELECT {HHS_BAND} AS hb, rb, FCG, sl FROM
  (SELECT coalesce(HHSBedHung, 0) + coalesce(HHSNoFood, 0) + coalesce(HHSNotEat, 0) AS h, {RCSI_MX} AS rb, FCG, {STRAIGHT} AS sl FROM flagged) x),
t AS (SELECT count(*) FILTER (WHERE sl) AS straight_line, count(*) FILTER (WHERE hb IS NOT NULL AND rb IS NOT NULL) AS total,
  count(*) FILTER (WHERE hb IN ('2-3', '4', '5-6') AND rb = '<4' AND FCG IN ('Acceptable', 'Borderline')) AS illogical FROM b)
SELECT *, {_pct('illogical', 'total')} AS illogical_pct FROM t""")
    q["hdds_mean_by_area"] = _with('SELECT ADMIN2Name AS "group", avg(HDDS) AS mean, count(*) AS n FROM flagged '
                                   "WHERE ADMIN2Name IS NOT NULL AND HDDS IS NOT NULL GROUP BY 1")
    q["score_trend"] = _with("SELECT CAST(today AS VARCHAR) AS date, avg(FCS) AS mean_fcs, avg(rCSI) AS mean_rcsi, avg(HDDS) AS mean_hdds "
                             "FROM flagged WHERE today IS NOT NULL GROUP BY 1")
    q["lcs_response_dist"] = _with(" UNION ALL ".join(
        f"SELECT '{c}' AS strategy, '{_tier_of(c)}' AS tier, {code} AS code, count(*) FILTER (WHERE {_q(c)} = {code}) AS n, "
        f"{_pct(f'count(*) FILTER (WHERE {_q(c)} = {code})', 'count(*)')} AS pct FROM flagged"
        for c in LCS for code in (9999, 10, 20, 30)))
    q["lcs_na_rate"] = _with(" UNION ALL ".join(
        f"SELECT EnuName AS enumerator, '{c}' AS strategy, '{_tier_of(c)}' AS tier, "
        f"avg(CASE WHEN {_q(c)} = 9999 THEN 1 ELSE 0 END) * 100.0 AS na_pct, {str(c in LCS_E).upper()} AS na_invalid "
        "FROM flagged WHERE EnuName IS NOT NULL GROUP BY 1" for c in LCS))
    q["five_number_by_group"] = _with(_five("EnuName", "Timing_Duration_Min"))
    q["fcs_box_by_area"] = _with(_five("ADMIN2Name", "FCS"))
    q["rcsi_box_by_area"] = _with(_five("ADMIN2Name", "rCSI"))
    for name, group, value in (("box_outliers", "EnuName", "Timing_Duration_Min"), ("fcs_outliers_by_area", "ADMIN2Name", "FCS"),
                               ("rcsi_outliers_by_area", "ADMIN2Name", "rCSI")):
        q[name] = _with(f""", f5 AS ({_five(group, value)})
SELECT _uuid AS id, row_seq, {group} AS "group", {value} AS value
FROM flagged JOIN f5 ON flagged.{group} = f5."group"
WHERE {value} IS NOT NULL AND ({value} < lower_fence OR {value} > upper_fence)""")
    q["tukey_outliers"] = _with(" UNION ALL ".join(f"""SELECT '{m}' AS metric, n, q1, q3, q1 - 1.5 * (q3 - q1) AS lower_fence,
  q3 + 1.5 * (q3 - q1) AS upper_fence,
  CAST(CASE WHEN n >= 4 THEN (SELECT count(*) FROM flagged WHERE {m} < q1 - 1.5 * (q3 - q1) OR {m} > q3 + 1.5 * (q3 - q1)) ELSE 0 END AS BIGINT) AS n_outliers
FROM (SELECT count({m}) AS n, quantile_cont({m}, 0.25) AS q1, quantile_cont({m}, 0.75) AS q3 FROM flagged) t{i}"""
                                                     for i, m in enumerate(["FCS", "rCSI"])))
    q["start_hour_hist"] = _with("SELECT EnuName AS enumerator, CAST(floor(Timing_StartHour) AS INTEGER) AS hour, "
                                 "count(*) AS n FROM flagged WHERE EnuName IS NOT NULL AND Timing_StartHour IS NOT NULL "
                                 "GROUP BY 1, 2")
    q["score_hist"] = _with(" UNION ALL ".join(
        f"SELECT '{m}' AS metric, bin, CAST({lo} AS DOUBLE) + CAST(bin AS DOUBLE) * CAST({hi - lo} AS DOUBLE) "
        f"/ CAST({nb} AS DOUBLE) AS bin_start, count(*) AS n FROM "
        f"(SELECT CAST(floor(({m} - CAST({lo} AS DOUBLE)) / CAST({(hi - lo) / nb!r} AS DOUBLE)) AS BIGINT) "
        f"AS bin FROM flagged WHERE {m} IS NOT NULL) t GROUP BY bin"
        for m, lo, hi, nb in (("FCS", 0.0, 112.0, 40), ("rCSI", 0.0, 56.0, 30))))
    cells = [(h, r, f) for h in ("0", "1", "2-3", "4", "5-6") for r in ("<4", "4-18", ">18")
             for f in ("Acceptable", "Borderline", "Poor")]
    q["consistency_matrix"] = _with(f""", b AS (SELECT {HHS_BAND} AS hb, rb, FCG FROM
  (SELECT coalesce(HHSBedHung, 0) + coalesce(HHSNoFood, 0) + coalesce(HHSNotEat, 0) AS h, {RCSI_MX} AS rb, FCG FROM flagged) x),
tot AS (SELECT count(*) AS total FROM b WHERE hb IS NOT NULL AND rb IS NOT NULL),
dim AS (SELECT * FROM (VALUES {', '.join(f"('{h}', '{r}', '{f}')" for h, r, f in cells)}) v(hhs_band, rcsi_band, fcg)),
cnt AS (SELECT hb, rb, FCG, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT dim.hhs_band, dim.rcsi_band, dim.fcg, coalesce(cnt.n, 0) AS n, tot.total,
  {_pct('coalesce(cnt.n, 0)', 'tot.total')} AS pct,
  (dim.hhs_band IN ('2-3', '4', '5-6') AND dim.fcg IN ('Acceptable', 'Borderline') AND dim.rcsi_band = '<4') AS illogical
FROM dim CROSS JOIN tot LEFT JOIN cnt ON cnt.hb = dim.hhs_band AND cnt.rb = dim.rcsi_band AND cnt.FCG = dim.fcg""")
    items = EXP["HHExpF"][0]
    long = " UNION ALL ".join(f"SELECT '{c}' AS item, {_q(c)} AS value FROM flagged" for c in items)
    q["expenditure_extremes"] = _with(f""", l AS (SELECT * FROM ({long}) t WHERE value IS NOT NULL),
r AS (SELECT item, value, row_number() OVER (PARTITION BY item ORDER BY value ASC) AS lo,
             row_number() OVER (PARTITION BY item ORDER BY value DESC) AS hi FROM l)
SELECT item, 'smallest' AS kind, CAST(lo AS INTEGER) AS pos, value FROM r WHERE lo <= 5
UNION ALL SELECT item, 'largest' AS kind, CAST(hi AS INTEGER) AS pos, value FROM r WHERE hi <= 5
UNION ALL SELECT item, 'median' AS kind, 1 AS pos, quantile_cont(value, 0.5) AS value FROM l GROUP BY item""")
    q["missing_rate_matrix"] = _with(" UNION ALL ".join(
        f"SELECT EnuName AS enumerator, '{m}' AS module, avg(coalesce(Flag_{m}_Missing, 0)) * 100.0 AS missing_pct "
        "FROM flagged WHERE EnuName IS NOT NULL GROUP BY 1" for m in MODULES))
    q["enumerator_feedback"] = _with(
        f"SELECT EnuName AS enumerator, count(*) AS total_surveys, count(*) FILTER (WHERE {_any_flag()} = 1) AS flagged_records, "
        f"{_pct(f'count(*) FILTER (WHERE {_any_flag()} = 1)', 'count(*)')} AS flag_rate_pct "
        "FROM flagged WHERE EnuName IS NOT NULL GROUP BY 1")
    q["progress"] = _with(f""", h AS (SELECT count(*) AS n,
  CAST(coalesce(floor((epoch(max(CAST(today AS TIMESTAMP))) - epoch(min(CAST(today AS TIMESTAMP)))) / 86400) + 1, 0) AS BIGINT) AS days_active
  FROM flagged)
SELECT n, {TARGET} AS target, CAST(n AS DOUBLE) / {TARGET}.0 * 100.0 AS pct_done,
  CAST(greatest({TARGET} - n, 0) AS BIGINT) AS remaining, days_active,
  CASE WHEN days_active > 0 THEN CAST(n AS DOUBLE) / days_active END AS avg_per_day,
  CAST(CASE WHEN days_active > 0 AND CAST(n AS DOUBLE) / days_active > 0 AND greatest({TARGET} - n, 0) > 0
       THEN ceil(greatest({TARGET} - n, 0) / (CAST(n AS DOUBLE) / days_active)) END AS BIGINT) AS days_to_finish,
  greatest({TARGET} - n, 0) = 0 AS complete,
  CASE WHEN least(CAST(n AS DOUBLE) / {TARGET}.0, 1.0) >= 0.9 THEN 'green'
       WHEN least(CAST(n AS DOUBLE) / {TARGET}.0, 1.0) >= 0.5 THEN 'amber' ELSE 'red' END AS band
FROM h""")
    for name, key, out in (("enumerator_completion", "EnuName", "enumerator"), ("area_completion", "ADMIN2Name", "area")):
        q[name] = _with(f""", cc AS (SELECT {key} AS {out}, count(*) AS completed FROM flagged WHERE {key} IS NOT NULL GROUP BY 1),
t AS (SELECT *, CAST(round_even({TARGET}.0 / count(*) OVER (), 0) AS BIGINT) AS target FROM cc)
SELECT {out}, completed, target, CAST(completed AS DOUBLE) / target * 100.0 AS pct_done,
  greatest(target - completed, 0) AS remaining,
  CASE WHEN round_even(CAST(completed AS DOUBLE) / target * 100.0, 1) >= 80 THEN 'On track'
       WHEN round_even(CAST(completed AS DOUBLE) / target * 100.0, 1) >= 50 THEN 'Behind' ELSE 'Critical' END AS status
FROM t""")
    q["survey_shape"] = f"WITH s AS ({survey_sql()}) SELECT count(*) AS n_rows, CAST({len(_survey_columns())} AS BIGINT) AS n_columns FROM s"
    # The ingest of the survey as text, a few answers of five columns made unreadable or blank.
    hurt = {"HHSize": ("row_seq % 97 = 5", "many"), "FCSStap": ("row_seq % 89 = 3", "5d"), "today": ("row_seq % 83 = 7", "31/31/2024"),
            "start": ("row_seq % 101 = 9", "soon"), "rCSIBorrow": ("row_seq % 79 = 2", None)}
    declared = {c: x.kind for c, x in declared_specs().items() if c in dict(SURVEY_COLUMNS)}
    q["ingest_report"] = f"WITH s AS ({survey_sql()}) " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS kind, count(*) AS n_rows, count({_q(c)}) FILTER (WHERE NOT ({hurt.get(c, ('false', None))[0]})) AS n_answers,
  count(*) FILTER (WHERE {hurt[c][0] if c in hurt and hurt[c][1] else 'false'}) AS n_unparsed FROM s""" for c, kind in declared.items())
    q["unparsed_values"] = f"WITH s AS ({survey_sql()}) " + " UNION ALL ".join(
        f"""SELECT CAST(row_seq AS BIGINT) AS row_seq, '{c}' AS "column", '{text}' AS text FROM s WHERE {cond}""" for c, (cond, text) in hurt.items() if text)
    q["survey_preview"] = (f"WITH s AS ({survey_sql()}) SELECT _uuid, row_seq, EnuName, CAST(today AS VARCHAR) AS today, FCSStap FROM s "
                           "ORDER BY row_seq LIMIT 5")
    q.update(_deliverables())
    # The same figures as files read back, as text coerced back, as displayed.
    q["written_master_sheet"] = q["master_sheet"]
    q["written_error_logs"] = _with(" UNION ALL ".join(
        f"SELECT '{m}' AS module, count(*) AS n FROM flagged WHERE Flag_{m}_Overall = 1" for m in MODULES))
    q["written_feedback_rows"] = _with(f"SELECT EnuName AS enumerator, count(*) AS n FROM flagged WHERE EnuName IS NOT NULL "
                                       f"AND {_any_flag()} = 1 GROUP BY 1")
    q["enumerators_displayed"] = (f"SELECT enumerator, surveys, round_even(rate_pct, 1) AS rate_pct, round_even(survey_share_pct, 1) AS survey_share_pct "
                                  f"FROM ({q['flag_rate_by_enumerator']}) r")
    q["checks_from_text"] = _with("SELECT _uuid, row_seq, CAST(today AS VARCHAR) AS today, HHSize, FCS, Timing_Duration_Min, " + ", ".join(
        f"CAST(Flag_{m}_Overall AS DOUBLE) AS Flag_{m}_Overall" for m in ("Demo", "FCS", "Timing")) + " FROM flagged")
    q["clashing_input"] = _with("SELECT row_seq, FCS, row_seq * 2.0 AS FCS_input, CAST(Flag_FCS_Overall AS DOUBLE) AS Flag_FCS_Overall, "
                                "CAST(Flag_HDDS_Overall AS DOUBLE) AS Flag_HDDS_Overall, 'FCS,HDDS' AS modules FROM flagged")
    # a stream's tables as of its last batch are those of all rows
    for streamed, whole in (("stream_daily_counts", "daily_counts_cumulative"), ("stream_score_trend", "score_trend"), ("stream_progress", "progress")):
        q[streamed] = q[whole]
    return q


def _survey_columns():
    from ..sources.fixture import SURVEY_COLUMNS
    return SURVEY_COLUMNS



# -- narratives (same wording as the Spark builders, restated in SQL) ---------------

def _num(c: str) -> str:
    return (f"CASE WHEN {c} = floor({c}) AND abs({c}) < 1e15 THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) || '.0' "
            f"ELSE CAST({c} AS VARCHAR) END")


def _fmt(c: str, digits: int) -> str:
    return f"format('{{:,.{digits}f}}', {c})"


def _names(pairs) -> str:
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in pairs) + ")"


def _missing_text(cols) -> str:
    return "'Missing answers: ' || " + _names([(c, f"{_q(c)} IS NULL") for c in cols])


def _range_text(specs) -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN '{c}=' || {_num(_q(c))} END" for c, cond in specs)
    return f"'Out of range: ' || concat_ws(', ', {items})"


def _rng(c, lo, hi):
    return f"({_q(c)} < {lo} OR {_q(c)} > {hi})"


def _choice(c, codes):
    return f"({_q(c)} IS NOT NULL AND {_q(c)} NOT IN ({', '.join(str(x) for x in codes)}))"


def _narratives() -> dict[str, list[tuple[str, str]]]:
    """(flag column, message) per module, in narrative order."""
    fcs_cols = [c for c, _ in FCS_W]
    rcsi_cols = [c for c, _ in RCSI_W]
    demo_req = ["HHSize"] + DEMO_M + DEMO_F
    n = {
        "Demo": [
            ("Missing", _missing_text(demo_req)),
            ("Erroneous", _range_text([("HHSize", _rng("HHSize", 1, 99))] + [(c, _rng(c, 0, 30)) for c in DEMO_M + DEMO_F]
                                      + [("HHPregLactNb", _rng("HHPregLactNb", 0, 20))])),
            ("HighHHSize", f"'Household size ' || {_num('HHSize')} || ' is above 30'"),
            ("SumMismatch", f"'Roster total ' || {_num('Sum_All')} || ' differs from household size ' || {_num('HHSize')} "
                            "|| ' by more than 1'"),
            ("NoAdults", "'Roster lists no member aged 18 or over'"),
            ("PLWExceeds", f"'Pregnant/lactating count ' || {_num('HHPregLactNb')} || ' exceeds females aged 12-59 (' "
                           f"|| {_num('Sum_F1259')} || ')'"),
        ],
        "FCS": [
            ("Missing", _missing_text(fcs_cols)),
            ("Erroneous", _range_text([(c, _rng(c, 0, 7)) for c in fcs_cols])),
            ("Identical", "'All 8 food-group answers are the same non-zero value'"),
            ("LowStaple", f"'Staples eaten on ' || {_num('FCSStap')} || ' days, fewer than 1'"),
            ("Low", f"'FCS ' || {_num('FCS')} || ' is below 10'"),
            ("High", f"'FCS ' || {_num('FCS')} || ' is above 112'"),
        ],
        "HDDS": [
            ("Missing", _missing_text(HDDS)),
            ("Erroneous", _range_text([(c, _rng(c, 0, 1)) for c in HDDS])),
            ("Low", f"'Dietary diversity ' || {_num('HDDS')} || ' is below 3'"),
            ("AllGroups", "'Every one of the 10 food groups reported as eaten'"),
        ],
        "rCSI": [
            ("Missing", _missing_text(rcsi_cols)),
            ("Erroneous", _range_text([(c, _rng(c, 0, 7)) for c in rcsi_cols])),
            ("Identical", "'All 5 coping answers are the same non-zero value'"),
            ("ZeroWithPoorFCG", "'No coping reported although food consumption is Poor'"),
            ("HighWithAcceptFCG", f"'rCSI ' || {_num('rCSI')} || ' above 18 although food consumption is Acceptable'"),
            ("AdultMealNoChildren", "'Adults ate less so children could eat, but the roster has no children'"),
        ],
        "Housing": [
            ("Missing", _missing_text(["HHStatus"])),
            ("Erroneous", _range_text([("HHStatus", _choice("HHStatus", [1, 2, 3, 4, 5, 6])),
                                       ("HHTenureType", _choice("HHTenureType", [1, 2, 3, 4, 5]))])),
            ("DisplacedOwner", f"'Displaced household (status ' || {_num('HHStatus')} || ') reports owning its dwelling'"),
        ],
        "LCS": [
            ("Missing", _missing_text(LCS)),
            ("Erroneous", _range_text([(c, _choice(c, [10, 20, 30, 9999])) for c in LCS])),
            ("ChildStratNoChildren", "'A child-related coping strategy was used, but the roster has no children'"),
            ("AllNA_PoorFood", "'No strategy is said to apply although food consumption is Poor'"),
            ("NonSequential", "'Emergency strategy used without any stress or crisis strategy'"),
            ("ManyNA", "CAST(coalesce(" + " + ".join(f"CASE WHEN {_q(c)} = 9999 THEN 1 ELSE 0 END" for c in LCS)
             + ", 0) AS VARCHAR) || ' strategies marked not applicable'"),
        ],
    }
    for m, (cols, hi) in EXP.items():
        hi_txt = f"{hi:,}"
        n[m] = [
            ("Missing", f"'Every {m} amount is missing'"),
            ("Erroneous", "'Negative amounts: ' || " + _names([(c, f"{_q(c)} < 0") for c in cols])),
            ("ZeroTotal", f"'Every {m} amount is zero or blank'"),
            ("BelowMinPrice", f"'Amounts above 0 but below {MIN_PRICE}: ' || concat_ws(', ', "
             + ", ".join(f"CASE WHEN {_q(c)} > 0 AND {_q(c)} < {MIN_PRICE} THEN '{c}=' || {_fmt(_q(c), 2)} END" for c in cols)
             + ")"),
            ("ExtremeItem", f"'Amounts above {hi_txt}: ' || " + _names([(c, f"{_q(c)} > {hi}") for c in cols])),
        ]
    dur = "Timing_Duration_Min"
    n["Timing"] = [
        ("Missing", _missing_text(["start", "end"])),
        ("Erroneous", "'Interview ends before it starts'"),
        ("InvalidDuration", f"'Duration ' || {_fmt(dur, 1)} || ' min is not above 0'"),
        ("ShortDuration", f"'Short interview: ' || {_fmt(dur, 1)} || ' min, under 10'"),
        ("LongDuration", f"'Long interview: ' || {_fmt(dur, 1)} || ' min, over 120'"),
        ("AbnormalHour", f"'Started at local hour ' || {_num('Timing_StartHour')} || ', outside 7:00-19:00'"),
    ]
    return n


def _narrative(m: str) -> str:
    parts = ", ".join(f"CASE WHEN Flag_{m}_{c} = 1 THEN {msg} END" for c, msg in _narratives()[m])
    return f"CASE WHEN concat_ws('; ', {parts}) = '' THEN 'No issues found' ELSE concat_ws('; ', {parts}) END"


CONTEXT = ["_uuid", "EnuName", "EnuSupervisorName", "ADMIN1Name", "ADMIN2Name"]


def _deliverables() -> dict[str, str]:
    from ..operators.deliver import CHECK_TEXTS  # wording only; severities are restated below

    q: dict[str, str] = {}
    narr = ",\n  ".join(f"{_narrative(m)} AS Flag_{m}_Narrative" for m in MODULES)
    cte = FLAGGED + f",\nfn AS (SELECT *,\n  {narr}\n  FROM flagged)"
    for m in MODULES:
        cols = ["row_seq"] + CONTEXT + ["CAST(today AS VARCHAR) AS today"] + DERIVED_VIEW.get(m, [])
        cols += [f"CAST(Flag_{m}_{c} AS DOUBLE) AS Flag_{m}_{c}" for c in CHECKS[m] + ["Overall"]]
        cols.append(f"Flag_{m}_Narrative")
        q[f"error_log_{m.lower()}"] = _with(f"SELECT {', '.join(cols)} FROM fn WHERE Flag_{m}_Overall = 1", cte)
    row_narr = "concat_ws(' || ', " + ", ".join(
        f"CASE WHEN Flag_{m}_Overall = 1 THEN '[{m}] ' || Flag_{m}_Narrative END" for m in MODULES) + ")"
    per_module = ", ".join(f"lr.Flag_{m}_Overall AS {m}_Flag, lr.Flag_{m}_Narrative AS {m}_Issues" for m in MODULES)
    q["master_sheet"] = _with(f""", ids AS (
  SELECT _uuid, max(row_seq) AS last_seq, max({_any_flag()}) AS idf FROM fn WHERE _uuid IS NOT NULL GROUP BY 1),
lr AS (SELECT fn.* FROM fn JOIN ids ON fn._uuid = ids._uuid AND fn.row_seq = ids.last_seq WHERE ids.idf = 1)
SELECT f._uuid, f.EnuName, f.EnuSupervisorName, f.ADMIN1Name, f.ADMIN2Name, CAST(f.today AS VARCHAR) AS today,
  f.row_seq, {row_narr.replace('Flag_', 'f.Flag_')} AS Flag_All_Narrative, {per_module}
FROM fn f JOIN lr ON f._uuid = lr._uuid""", cte)
    q["master_narratives"] = _with(" UNION ALL ".join(
        f"SELECT _uuid AS id, '{m}' AS module, CAST({i} AS INTEGER) AS module_pos, row_seq, Flag_{m}_Narrative AS text "
        f"FROM fn WHERE _uuid IS NOT NULL AND Flag_{m}_Overall = 1" for i, m in enumerate(MODULES)), cte)

    critical = ("Timing.ShortDuration", "FCS.Identical", "rCSI.ZeroWithPoorFCG", "rCSI.Identical", "LCS.AllNA_PoorFood")
    warn = ("Timing.LongDuration", "Timing.AbnormalHour", "FCS.Low", "FCS.LowStaple", "FCS.Missing", "rCSI.AdultMealNoChildren", "rCSI.Missing",
            "LCS.ManyNA", "LCS.NonSequential", "LCS.ChildStratNoChildren", "LCS.Missing", "Demo.SumMismatch", "Demo.Missing",
            "Housing.DisplacedOwner", "Housing.Missing", "HHExpF.ExtremeItem", "HHExpF.Missing", "HDDS.Low", "HDDS.Missing")
    texts = ", ".join("('{}', '{}', '{}')".format(c, *(t.replace("'", "''") for t in pair)) for c, pair in CHECK_TEXTS.items())
    key = """cc.module || '.' || cc."check\""""
    q["issue_ranking"] = _with(f""", cc AS ({_check_counts_body()}),
txt AS (SELECT * FROM (VALUES {texts}) v("check", description, action)),
j AS (SELECT cc.module, cc."check", cc.n_flagged, cc.check_pos,
        CASE WHEN {key} IN {critical} THEN 'critical' WHEN {key} IN {warn} THEN 'warn' ELSE 'info' END AS severity,
        txt.description, txt.action
      FROM cc LEFT JOIN txt ON cc."check" = txt."check" WHERE cc.n_flagged > 0),
k AS (SELECT *, CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS INTEGER) AS severity_rank FROM j)
SELECT *, CAST(n_flagged AS DOUBLE) / (SELECT count(*) FROM flagged) * 100.0 AS pct,
  CAST(row_number() OVER (ORDER BY severity_rank, n_flagged DESC, check_pos) AS INTEGER) AS rank FROM k""")

    def rates(key: str) -> str:
        return f"""(SELECT p._g AS name, {_pct("count(*) FILTER (WHERE i._idf = 1 AND p._id IS NOT NULL)", "sum(p._n)")} AS r
  FROM (SELECT _uuid AS _id, {key} AS _g, count(*) AS _n, max({_any_flag()}) AS _f FROM flagged GROUP BY 1, 2) p
  JOIN (SELECT _uuid AS _id, max({_any_flag()}) AS _idf FROM flagged GROUP BY 1) i ON p._id IS NOT DISTINCT FROM i._id
  WHERE p._g IS NOT NULL GROUP BY 1)"""

    overall = (f"(SELECT round_even({_pct(f'count(DISTINCT CASE WHEN {_any_flag()} = 1 THEN _uuid END)', 'count(*)')}, 1) "
               "AS v FROM flagged)")
    q["priority_alerts"] = _with(f""", a AS (
  SELECT 0 AS position, 'critical' AS level, 'duplicate_ids' AS rule, CAST(NULL AS VARCHAR) AS entity, CAST(v AS DOUBLE) AS value
    FROM (SELECT count(*) AS v FROM (SELECT _uuid FROM flagged WHERE _uuid IS NOT NULL GROUP BY 1 HAVING count(*) > 1) d) t WHERE v > 0
  UNION ALL SELECT 1, 'critical', 'overall_flag_rate', NULL, v FROM {overall} t WHERE v > 20
  UNION ALL SELECT 2, 'warning', 'enumerator_flag_rate', name, round_even(r, 1) FROM {rates('EnuName')} t
    WHERE round_even(r, 1) > 30
  UNION ALL SELECT 3, 'warning', 'area_flag_rate', name, round_even(r, 1) FROM {rates('ADMIN1Name')} t
    WHERE round_even(r, 1) > 30
  UNION ALL SELECT 4, 'warning', 'straight_lining', NULL, CAST(v AS DOUBLE)
    FROM (SELECT count(*) FILTER (WHERE {STRAIGHT}) AS v FROM flagged) t WHERE v > 0)
SELECT CAST(position AS INTEGER) AS position, level, rule, entity, value FROM a""")

    def named(src: str, cond: str) -> str:
        return f"(SELECT round_even(r, 1) AS v, name AS e FROM {src} s WHERE {cond})"

    def chk(m: str, c: str) -> str:
        return f"(SELECT CAST(count(*) FILTER (WHERE Flag_{m}_{c} = 1) AS DOUBLE) AS v, CAST(NULL AS VARCHAR) AS e FROM flagged)"

    poor = "(SELECT round_even(CAST(count(*) FILTER (WHERE FCG = 'Poor') AS DOUBLE) / count(*) * 100.0, 1) AS v FROM flagged)"
    rules = [
        (0, "overall_rate_above_20", f"(SELECT v, CAST(NULL AS VARCHAR) AS e FROM {overall} t WHERE v > 20)"),
        (1, "overall_rate_above_10", f"(SELECT v, CAST(NULL AS VARCHAR) AS e FROM {overall} t WHERE v > 10 AND v <= 20)"),
        (2, "enumerators_above_30", named(rates("EnuName"), "round_even(r, 1) > 30")),
        (3, "enumerators_15_to_30", named(rates("EnuName"), "round_even(r, 1) > 15 AND round_even(r, 1) <= 30")),
        (4, "poor_fcg_above_30", f"(SELECT v, CAST(NULL AS VARCHAR) AS e FROM {poor} t WHERE v > 30)"),
        (5, "short_interviews", chk("Timing", "ShortDuration")),
        (6, "many_lcs_not_applicable", chk("LCS", "ManyNA")),
        (7, "roster_mismatch", chk("Demo", "SumMismatch")),
        (8, "no_coping_with_poor_fcg", chk("rCSI", "ZeroWithPoorFCG")),
        (9, "identical_fcs", chk("FCS", "Identical")),
        (10, "areas_above_30", named(rates("ADMIN1Name"), "round_even(r, 1) > 30")),
    ]
    fired = " UNION ALL ".join(f"SELECT {o} AS position, '{c}' AS code, CAST(v AS DOUBLE) AS value, e AS entity "
                               f"FROM {src} x WHERE v > 0" for o, c, src in rules)
    q["recommendations"] = _with(f""", fired AS ({fired})
SELECT * FROM fired
UNION ALL SELECT 11, 'quality_acceptable', NULL, NULL WHERE (SELECT count(*) FROM fired) = 0""")
    return q


ORACLE_SQL: dict[str, str] = _queries()
