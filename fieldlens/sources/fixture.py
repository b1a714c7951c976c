"""Deterministic survey table derived from the driver's ``events`` table.

The driver ships no survey data, so every registered query reads ``events``
and turns each event into one household interview with plain integer
arithmetic (FIXTURES.md §3).  The same SQL expression text runs in Spark and
in DuckDB; only the quoting of the output names differs.  The work therefore
grows with ``events`` and every row of it is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# The derived-survey expressions of FIXTURES.md §3, verbatim.
# ---------------------------------------------------------------------------

PLANT_KEY = (
    "CASE WHEN user_id % 12 >= 4 AND event_id % 5 <> 0 THEN 1 ELSE event_id END"
)


def _fcs_group(a: int, b: int, c: int, seven: int = 7, null_mod: int | None = None) -> str:
    head = f"WHEN k % {null_mod} = 0 THEN NULL " if null_mod else ""
    base = f"(event_id*{a}+user_id*{b}+{c})"
    return (
        f"CAST(CASE {head}WHEN k % 41 = 0 THEN k % 8 "
        f"WHEN user_id % 12 = 5 AND event_id % 3 = 0 THEN 3 "
        f"WHEN k % 53 = 0 THEN 0 WHEN k % 59 = 0 THEN {seven} "
        f"WHEN event_id % 4 = 0 THEN {base} % 2 ELSE {base} % 8 END AS DOUBLE)"
    )


_HH_PARTS = {
    "HHSize01M": "CASE WHEN k % 18 = 0 THEN 0 ELSE (event_id*3+user_id*1+0) % 3 END",
    "HHSize24M": "CASE WHEN k % 18 = 0 THEN 0 ELSE (event_id*7+user_id*1+4) % 3 END",
    "HHSize511M": "CASE WHEN k % 18 = 0 THEN 0 ELSE 1 + (event_id*11+user_id*1+16) % 2 END",
    "HHSize1217M": "CASE WHEN k % 18 = 0 THEN 0 ELSE (event_id*15+user_id*1+36) % 3 END",
    "HHSize1859M": "CASE WHEN k % 37 = 0 THEN 0 WHEN k % 71 = 0 THEN 28 ELSE (event_id*19+user_id*1+64) % 3 END",
    "HHSize60AboveM": "CASE WHEN k % 37 = 0 THEN 0 ELSE (event_id*23+user_id*1+100) % 3 END",
    "HHSize01F": "CASE WHEN k % 18 = 0 THEN 0 ELSE (event_id*5+user_id*1+1) % 3 END",
    "HHSize24F": "CASE WHEN k % 18 = 0 THEN 0 ELSE (event_id*9+user_id*1+9) % 3 END",
    "HHSize511F": "CASE WHEN k % 18 = 0 THEN 0 ELSE (event_id*13+user_id*1+25) % 3 END",
    "HHSize1217F": "CASE WHEN k % 18 = 0 THEN 0 ELSE (event_id*17+user_id*1+49) % 3 END",
    "HHSize1859F": "CASE WHEN k % 37 = 0 THEN 0 ELSE 1 + (event_id*21+user_id*1+81) % 2 END",
    "HHSize60AboveF": "CASE WHEN k % 37 = 0 THEN 0 ELSE (event_id*25+user_id*1+121) % 3 END",
}

_HDDS_FLAT = "CAST(CASE WHEN k % 31 = 0 THEN 1 WHEN k % 43 = 0 THEN 0 ELSE 1 END AS DOUBLE)"


def _hdds(a: int, b: int, c: int, head: str = "") -> str:
    return (
        f"CAST(CASE {head}WHEN k % 31 = 0 THEN 1 WHEN k % 43 = 0 THEN 0 "
        f"WHEN (event_id*{a}+user_id*{b}+{c}) % 11 < 5 THEN 1 ELSE 0 END AS DOUBLE)"
    )


def _lcs_low(a: int, b: int, c: int, head: str = "") -> str:
    base = f"(event_id*{a}+user_id*{b}+{c})"
    return (
        f"CAST(CASE {head}WHEN k % 16 = 0 THEN 9999 WHEN k % 19 = 0 THEN 10 "
        f"WHEN event_id % 15 = 0 THEN 20 WHEN {base} % 23 = 0 THEN 9999 "
        f"WHEN {base} % 23 = 1 THEN 30 WHEN {base} % 23 = 2 THEN 20 ELSE 10 END AS DOUBLE)"
    )


def _lcs_em(a: int, b: int, c: int) -> str:
    return (
        f"CAST(CASE WHEN k % 16 = 0 THEN 9999 WHEN k % 19 = 0 THEN 30 "
        f"WHEN event_id % 15 = 0 THEN 30 WHEN (event_id*{a}+user_id*{b}+{c}) % 23 = 0 THEN 9999 "
        f"ELSE 10 END AS DOUBLE)"
    )


def _exp_main(r: int, a: int, c: int, big: int) -> str:
    return (
        f"CAST(CASE WHEN k % 97 = {r} THEN NULL WHEN k % 73 = {r} THEN 0 "
        f"WHEN k % 79 = {r} THEN -1 WHEN k % 83 = {r} THEN {big} WHEN k % 27 = {r} THEN 0.5 "
        f"ELSE value * ((event_id*{a}+user_id*1+{c}) % 7) + 6 END AS DOUBLE)"
    )


def _exp_side(r: int, a: int, c: int) -> str:
    return (
        f"CAST(CASE WHEN k % 97 = {r} THEN NULL WHEN k % 73 = {r} THEN 0 "
        f"WHEN event_id % 9 = 0 THEN NULL "
        f"ELSE value * ((event_id*{a}+user_id*1+{c}) % 7) + 6 END AS DOUBLE)"
    )


_START = (
    "CASE WHEN k % 179 = 0 THEN NULL ELSE ts + INTERVAL '1' HOUR * "
    "((CASE WHEN k % 89 = 0 THEN 3 ELSE 8 + event_id % 10 END) - hour(ts)) END"
)
_END = (
    "CASE WHEN k % 127 = 0 THEN NULL ELSE ts + INTERVAL '1' HOUR * "
    "((CASE WHEN k % 89 = 0 THEN 3 ELSE 8 + event_id % 10 END) - hour(ts)) + INTERVAL '1' MINUTE * "
    "(CASE WHEN k % 17 = 0 THEN 4 WHEN k % 107 = 0 THEN 300 WHEN k % 109 = 0 THEN 0 "
    "WHEN k % 113 = 0 THEN -10 WHEN user_id % 12 = 7 THEN 230 + event_id % 20 "
    "ELSE (event_id*7) % 100 + 15 END) END"
)

SURVEY_COLUMNS: list[tuple[str, str]] = [
    ("_uuid", "CASE WHEN event_id % 50 = 1 THEN event_id-1 ELSE event_id END"),
    ("row_seq", "event_id"),
    ("EnuName", "CASE WHEN event_id % 211 = 0 THEN NULL ELSE concat('ENU_', CAST(user_id % 12 AS VARCHAR(4))) END"),
    ("EnuSupervisorName", "concat('SUP_', CAST((user_id % 12) % 3 AS VARCHAR(4)))"),
    ("ADMIN1Name", "concat('REG_', CAST(user_id % 4 AS VARCHAR(4)))"),
    ("ADMIN2Name", "event_type"),
    ("today", "CAST(ts AS DATE)"),
    (
        "FCSStap",
        "CAST(CASE WHEN k % 61 = 0 THEN 9 WHEN k % 47 = 0 THEN 0 WHEN k % 41 = 0 THEN k % 8 "
        "WHEN user_id % 12 = 5 AND event_id % 3 = 0 THEN 3 WHEN k % 53 = 0 THEN 1 "
        "WHEN k % 59 = 0 THEN 7 WHEN event_id % 4 = 0 THEN 3 + event_id % 2 "
        "ELSE 3 + (event_id*3+user_id*1+0) % 5 END AS DOUBLE)",
    ),
    ("FCSPulse", _fcs_group(5, 2, 1, null_mod=67)),
    ("FCSDairy", _fcs_group(7, 3, 4)),
    ("FCSPr", _fcs_group(9, 4, 9)),
    ("FCSVeg", _fcs_group(11, 5, 16)),
    ("FCSFruit", _fcs_group(13, 6, 25)),
    ("FCSFat", _fcs_group(15, 7, 36)),
    ("FCSSugar", _fcs_group(17, 8, 49, seven=6)),
    (
        "rCSILessQlty",
        "CAST(CASE WHEN k % 139 = 0 THEN k % 8 WHEN k % 14 = 0 THEN 0 WHEN k % 33 = 0 THEN 5 "
        "ELSE (event_id*5+user_id*1+0) % 3 END AS DOUBLE)",
    ),
    (
        "rCSIBorrow",
        "CAST(CASE WHEN k % 131 = 0 THEN NULL WHEN k % 139 = 0 THEN k % 8 WHEN k % 14 = 0 THEN 0 "
        "WHEN k % 33 = 0 THEN 6 ELSE (event_id*7+user_id*2+1) % 3 END AS DOUBLE)",
    ),
    (
        "rCSIMealSize",
        "CAST(CASE WHEN k % 137 = 0 THEN 8 WHEN k % 139 = 0 THEN k % 8 WHEN k % 14 = 0 THEN 0 "
        "WHEN k % 33 = 0 THEN 5 ELSE (event_id*9+user_id*3+4) % 3 END AS DOUBLE)",
    ),
    (
        "rCSIMealAdult",
        "CAST(CASE WHEN k % 139 = 0 THEN k % 8 WHEN k % 14 = 0 THEN 0 WHEN k % 33 = 0 THEN 6 "
        "ELSE (event_id*11+user_id*4+9) % 3 END AS DOUBLE)",
    ),
    (
        "rCSIMealNb",
        "CAST(CASE WHEN k % 139 = 0 THEN k % 8 WHEN k % 14 = 0 THEN 0 WHEN k % 33 = 0 THEN 5 "
        "ELSE (event_id*13+user_id*5+16) % 3 END AS DOUBLE)",
    ),
    *[(name, f"CAST({expr} AS DOUBLE)") for name, expr in _HH_PARTS.items()],
    (
        "HHSize",
        "CAST(CASE WHEN k % 149 = 0 THEN NULL WHEN k % 151 = 0 THEN 0 WHEN k % 23 = 0 THEN {T} + 3 "
        "ELSE {T} END AS DOUBLE)".format(T="(" + " + ".join(f"({e})" for e in _HH_PARTS.values()) + ")"),
    ),
    ("HHPregLactNb", "CAST(CASE WHEN k % 29 = 0 THEN 8 WHEN event_id % 7 = 0 THEN NULL ELSE 0 END AS DOUBLE)"),
    ("HDDSStapCer", _HDDS_FLAT),
    ("HDDSPulse", _HDDS_FLAT),
    ("HDDSDairy", _HDDS_FLAT),
    ("HDDSPrMeat", _hdds(9, 4, 9, head="WHEN k % 157 = 0 THEN NULL ")),
    ("HDDSPrFish", _hdds(11, 5, 16, head="WHEN k % 163 = 0 THEN 2 ")),
    ("HDDSPrEggs", _hdds(13, 6, 25)),
    ("HDDSVeg", _hdds(15, 7, 36)),
    ("HDDSFruit", _hdds(17, 8, 49)),
    ("HDDSFat", _hdds(19, 9, 64)),
    ("HDDSSugar", _hdds(21, 10, 81)),
    ("Lcs_stress_DomAsset", _lcs_low(3, 1, 0)),
    ("Lcs_stress_EatOut", _lcs_low(5, 2, 1)),
    ("Lcs_stress_BorrowCash", _lcs_low(7, 3, 4)),
    ("Lcs_stress_Saving", _lcs_low(9, 4, 9)),
    ("Lcs_crisis_ProdAssets", _lcs_low(11, 5, 16)),
    ("Lcs_crisis_OutSchool", _lcs_low(13, 6, 25, head="WHEN k % 167 = 0 THEN NULL ")),
    ("Lcs_crisis_Health", _lcs_low(15, 7, 36, head="WHEN k % 173 = 0 THEN 40 ")),
    ("Lcs_em_Begged", _lcs_em(17, 8, 49)),
    ("Lcs_em_Migration", _lcs_em(19, 9, 64)),
    ("Lcs_em_ChildWork", _lcs_em(21, 10, 81)),
    (
        "HHStatus",
        "CAST(CASE WHEN k % 101 = 0 THEN NULL WHEN k % 103 = 0 THEN 9 WHEN k % 9 = 0 THEN 3 + k % 4 "
        "ELSE event_id % 2 + 1 END AS DOUBLE)",
    ),
    ("HHTenureType", "CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 5 + 1 END AS DOUBLE)"),
    ("HHExpFCer_Purch_MN_7D", _exp_main(0, 3, 0, 2000000)),
    (
        "HHExpFCer_OwnProd_MN_7D",
        "CAST(CASE WHEN k % 97 = 0 THEN NULL WHEN k % 73 = 0 THEN 0 WHEN event_id % 9 = 0 THEN NULL "
        "ELSE value * ((event_id*5+user_id*1+1) % 7) + 6 END AS DOUBLE)",
    ),
    ("HHExpFPulse_Purch_MN_7D", _exp_side(0, 7, 2)),
    ("HHExpFPulse_OwnProd_MN_7D", _exp_side(0, 9, 3)),
    ("HHExpFOil_Purch_MN_7D", _exp_side(0, 11, 4)),
    ("HHExpFOil_OwnProd_MN_7D", _exp_side(0, 13, 5)),
    ("HHExpNFHyg_Purch_MN_1M", _exp_main(3, 15, 6, 2000000)),
    ("HHExpNFWat_Purch_MN_1M", _exp_side(3, 17, 7)),
    ("HHExpNFCloth_Purch_MN_6M", _exp_main(2, 19, 8, 6000000)),
    ("HHExpNFRent_Purch_MN_6M", _exp_side(2, 21, 9)),
    ("start", _START),
    ("end", _END),
    ("HHSBedHung", "CAST((event_id*3+user_id*1+0) % 3 AS DOUBLE)"),
    ("HHSNoFood", "CAST((event_id*5+user_id*2+1) % 3 AS DOUBLE)"),
    ("HHSNotEat", "CAST((event_id*7+user_id*3+4) % 3 AS DOUBLE)"),
]


def survey_sql(quote: str = '"') -> str:
    """SELECT text that derives the survey from ``events`` (DuckDB quoting by default)."""
    cols = ",\n  ".join(f"{expr} AS {quote}{name}{quote}" for name, expr in SURVEY_COLUMNS)
    return f"SELECT\n  {cols}\nFROM (SELECT *, {PLANT_KEY} AS k FROM events) b"


def events_path(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/events.parquet"


def survey_from_events(events: DataFrame) -> DataFrame:
    """Project ``events`` into the derived survey table (narrow, no shuffle)."""
    keyed = events.selectExpr("*", f"{PLANT_KEY} AS k")
    return keyed.selectExpr(*[f"{expr} AS `{name}`" for name, expr in SURVEY_COLUMNS])


def load_fixture_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read ``events`` parquet under ``sf_dir`` and derive the survey."""
    return survey_from_events(spark.read.parquet(events_path(sf_dir)))
