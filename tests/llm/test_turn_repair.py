import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest

from fieldlens.llm import turn_repair as T

SCHEMA = "conv_id long, turn long, role string, text string, audit string, copies string"


def brute(rows):
    """The least (cost, letters) by uniform-cost search over all edit strings: no bounds, no tables."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, letters, i, roles = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters
        state = roles[-1:] if roles in ("", "s") else ("u" if roles[-1] == "u" else "a")
        turn = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 3, letters + "I", i, state_of(roles, turn)))
        if i < len(rows):
            initial, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, roles))
            if not gone:
                heapq.heappush(heap, (cost + 3 + 3 * cut, letters + "R", i + 1, state_of(roles, turn)))
                if initial == turn or initial == "s" and roles == "":
                    heapq.heappush(heap, (cost + 3 * cut, letters + "K", i + 1, state_of(roles, initial)))


def state_of(roles, new):
    """Roles so far, shortened to what matters: '', 's', 'u' or 'ua' (a whole pair)."""
    return {"s": "s", "u": "u", "a": "ua"}[new]


def test_search_is_exact_on_all_short_conversations():
    kinds = [(r, g, c) for r in "sua?" for g, c in ((False, False), (True, False), (False, True))]
    code = {"s": T.SYSTEM, "u": T.USER, "a": T.ASSISTANT, "?": T.START}
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert T.repair([(code[r], g, c) for r, g, c in rows]) == brute(rows), rows


def test_search_is_exact_on_longer_conversations():
    rng, code = random.Random(2), {"s": T.SYSTEM, "u": T.USER, "a": T.ASSISTANT, "?": T.START}
    for _ in range(300):
        rows = [(rng.choice("suauaua?"), rng.random() < .2, rng.random() < .2) for _ in range(rng.randrange(4, 11))]
        assert T.repair([(code[r], g, c) for r, g, c in rows]) == brute(rows), rows


def test_bounds_never_exceed_what_a_suffix_costs():
    rng = random.Random(4)
    for _ in range(200):
        rows = [(rng.randrange(4), rng.random() < .3, rng.random() < .3) for _ in range(8)]
        bound = T.suffix_bounds(rows)
        for i in range(9):
            assert bound[i][T.START] <= T.repair(rows[i:])[0]


def test_long_conversation_is_linear():
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 3, 2, 3, 0]), rng.random() < .1, rng.random() < .1) for _ in range(60_000)]
    cost, audit = T.repair(rows)
    assert sum(x != "I" for x in audit) == len(rows) and cost > 0


# --- whole tables, by plain Python ---------------------------------------------

def expected(rows):
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        got = []
        for c, turn, role, text, *_ in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if k == 0:
                continue
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            got += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in got:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        ini = [r[1][:1] for r in got]
        cost, audit = brute([(i if i in ("s", "u", "a") else "?", f in ("blank", "duplicate"), f == "truncated") for i, f in zip(ini, faults)])
        turns = [r[0] for r in got if r[0] is not None]
        fixed, source, roles = [], iter(got), ""
        for x in audit:
            row = next(source) if x != "I" else (None, None, "")
            if x != "D":
                new = row[1][:1] if x == "K" else "a" if roles[-1:] == "u" else "u"
                fixed.append(f"{row[1] if x == 'K' else {'u': 'user', 'a': 'assistant'}[new]}:{row[2]}")
                roles += new
        out[conv] = (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:])), cost, audit,
                     hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return sorted(out.values(), key=str)


def messy():
    rng = random.Random(9)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n\t", None, "Ünï. \x0b", "Yes.", "dots... and?\x1c", "long " * 20_000 + "end."]
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool"]), rng.choice(texts), "x", "y")
            for c in range(70) for t in range(rng.randrange(1, 7))]
    rows += [(None, 1, "user", "Hi.", "", ""), (None, None, "assistant", "Yes.", "", ""), (200, None, None, None, None, None),
             (201, 5, "user", "A.", "", ""), (201, 5, "user", "A.", "", ""), (201, 5, "assistant", "B.", "", ""), (201, 900, "system", "C.", "", ""),
             (202, 7, "", "No role.", "", "")]
    return rows + rows[:3]


def test_tables_equal_brute_force(spark):
    rows = messy()
    got = T.repair_all(T.damage(spark.createDataFrame(rows, SCHEMA).repartition(6)))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    assert got.columns == ["conv_id", *T.FIGURES, "audit", "repaired_sha256"]


def test_a_dropped_conversation_is_empty(spark):
    conv = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = T.repair_all(T.damage(spark.createDataFrame([(conv, 0, "user", "Hi.", "", "")], SCHEMA))).collect()
    assert tuple(got[0]) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_extremes_and_empty_table(spark):
    low, high = -2 ** 63, 2 ** 63 - 1
    df = spark.createDataFrame([(1, low, "user", "A.", "", ""), (1, high, "assistant", "B.", "", ""), (1, 3, "user", "C.", "", "")], SCHEMA)
    assert 0 <= T.repair_all(T.damage(df)).first().gaps <= high
    assert T.repair_all(T.damage(df.limit(0))).count() == 0
    assert T.repaired_rows(T.damage(df.limit(0))).count() == 0


def test_repaired_rows_read_well(spark):
    out = T.repaired_rows(T.damage(spark.createDataFrame(messy(), SCHEMA))).orderBy("conv_id", "position").collect()
    for conv, group in itertools.groupby(out, key=lambda r: r.conv_id):
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in group)), conv


@pytest.mark.parametrize("sf", ["0.001"])
def test_equals_sql(spark, sf):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf{sf}/conversations.parquet'")
    got = T.op11_turn_repair(spark, f"/root/testdata/sf{sf}")
    want = db.sql(T.OP11_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_narrow_rows_move_once(spark):
    """One exchange carries the rows without their texts: the window needs no other."""
    plan = T._narrow(T.damage(spark.createDataFrame(messy(), SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
