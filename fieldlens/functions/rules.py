"""Row-level rule expressions (C1-C8) as Spark SQL expression text.

Each builder returns SQL text; the engine turns every output column into one
``F.expr`` (a single call into the JVM per column instead of one per operator
node).  Flags are nullable integers: 1 = raised, 0 = passed, NULL = not
evaluated.  All comparisons are null-safe so that a NULL answer never raises
a flag, mirroring "NaN compares False" in the rule definitions.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from ..profile import ColumnSpec

# Fixed wording of our narratives (own text).
NO_ISSUES = "No issues found"
SEP_MESSAGES = "; "
SEP_ITEMS = ", "


def q(name: str) -> str:
    """Quoted column reference."""
    return f"`{name}`"


def num(v: float) -> str:
    """Double literal."""
    return f"{float(v)!r}D"


def text(s: str) -> str:
    """String literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def concat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def safe(cond: str) -> str:
    """NULL -> false."""
    return f"coalesce({cond}, false)"


def any_of(conds: Iterable[str]) -> str:
    conds = [safe(c) for c in conds]
    return "(" + " OR ".join(conds) + ")" if conds else "false"


def all_of(conds: Iterable[str]) -> str:
    conds = [safe(c) for c in conds]
    return "(" + " AND ".join(conds) + ")" if conds else "false"


def is_in(c: str, values: Sequence[float]) -> str:
    return safe(f"{c} IN ({', '.join(num(v) for v in values)})")


def sum_nulls_as_zero(names: Sequence[str]) -> str:
    """Row sum skipping NULLs; an all-NULL row sums to 0."""
    return "(" + " + ".join(f"coalesce({q(n)}, 0.0D)" for n in names) + ")"


def weighted_sum(weights: dict[str, float]) -> str:
    """Null-propagating weighted sum (plain ``+``)."""
    return "(" + " + ".join(f"{q(n)} * {num(w)}" for n, w in weights.items()) + ")"


def num_text(c: str) -> str:
    """Double as text, always with a decimal part: 9 -> '9.0', 0.5 -> '0.5'."""
    return (f"CASE WHEN {c} = floor({c}) AND abs({c}) < 1.0E15D "
            f"THEN concat(CAST(CAST({c} AS BIGINT) AS STRING), '.0') ELSE CAST({c} AS STRING) END")


def name_list(pairs: Sequence[tuple[str, str]]) -> str:
    """Comma list of the names whose condition holds (in the given order)."""
    if not pairs:
        return "''"
    items = ", ".join(f"CASE WHEN {safe(cond)} THEN {text(name)} END" for name, cond in pairs)
    return f"concat_ws({text(SEP_ITEMS)}, {items})"


# -- C1 / C2: missing ---------------------------------------------------------

def missing_any(required: Sequence[str]) -> str:
    """1 if any present required column is NULL; no column -> 0."""
    if not required:
        return "0"
    return f"CAST({any_of([f'{q(c)} IS NULL' for c in required])} AS INT)"


def missing_all(columns: Sequence[str]) -> str:
    """1 only if every listed column is NULL; no column -> 0."""
    if not columns:
        return "0"
    return f"CAST({all_of([f'{q(c)} IS NULL' for c in columns])} AS INT)"


def missing_text(required: Sequence[str]) -> str:
    return concat(text("Missing answers: "), name_list([(c, f"{q(c)} IS NULL") for c in required]))


# -- C3 / C4 / C5: erroneous --------------------------------------------------

def out_of_spec(spec: ColumnSpec) -> str:
    """Value below min, above max, or outside the code list (NULL never counts)."""
    c = q(spec.name)
    conds = []
    if spec.min is not None:
        conds.append(f"{c} < {num(spec.min)}")
    if spec.max is not None:
        conds.append(f"{c} > {num(spec.max)}")
    if spec.choices is not None:
        conds.append(f"({c} IS NOT NULL AND NOT {c} IN ({', '.join(num(v) for v in spec.choices)}))")
    return any_of(conds)


def erroneous_when_answered(missing: str, bad: str) -> str:
    """NULL when the module is missing, else the 0/1 outcome."""
    return f"CASE WHEN {missing} = 0 THEN CAST({safe(bad)} AS INT) END"


def erroneous_text(specs: Sequence[ColumnSpec]) -> str:
    if not specs:
        return text("Out of range: ")
    items = ", ".join(f"CASE WHEN {out_of_spec(s)} THEN concat({text(s.name + '=')}, {num_text(q(s.name))}) END"
                      for s in specs)
    return concat(text("Out of range: "), f"concat_ws({text(SEP_ITEMS)}, {items})")


# -- C6: gated check ----------------------------------------------------------

def gate(cond: str, missing: str, erroneous: str) -> str:
    """Evaluate only when missing == 0 and erroneous == 0; else NULL."""
    return f"CASE WHEN {missing} = 0 AND {erroneous} = 0 THEN CAST({safe(cond)} AS INT) END"


# -- C7: rollup -----------------------------------------------------------------

def rollup(flags: Sequence[str]) -> str:
    """1 if any flag equals 1 (NULL counts as no)."""
    if not flags:
        return "0"
    return "CAST(greatest(" + ", ".join(f"coalesce({f}, 0)" for f in flags) + ", 0) AS INT)"


# -- C8: narrative --------------------------------------------------------------

def narrative(parts: Sequence[tuple[str, str]]) -> str:
    """Messages of raised flags, in check order, joined by '; '."""
    joined = f"concat_ws({text(SEP_MESSAGES)}, " + ", ".join(f"CASE WHEN {flag} = 1 THEN {msg} END" for flag, msg in parts) + ")"
    return f"coalesce(nullif({joined}, ''), {text(NO_ISSUES)})"
