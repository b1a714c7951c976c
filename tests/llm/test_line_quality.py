import re
from collections import Counter

import pytest

from fieldlens.llm import line_quality as Q

SCHEMA = "doc_id long, text string, n_words string, kept string"
GOOD = "The house on the hill is old but it stands and nobody knows who built it."
ROWS = [(1, None, "x", "y"), (2, "", None, None), (3, " \n\t\v\f\r ", None, None), (4, "\n".join([GOOD] * 5), None, None),
        (5, " ".join(f"word{k}" for k in range(60)) + ".", None, None), (6, "\n".join(f"menu{k} | item{k} | more{k}" for k in range(40)), None, None),
        (7, "\n".join(f"LOUD{k} WORDS{k} HERE{k} ALWAYS." for k in range(30)), None, None), (8, "\n".join(f"w{k}%%% and{k}### so{k}$$$ on{k}." for k in range(20)), None, None),
        (9, "a b c a b c\x1cd a b c é b c é b c", None, None), (10, "a\n a\na \na\n\n\nb", None, None),
        (11, "\n".join(f"The {k} cat{k} of{k} house {k * 7} like{k} to{k} sleep." for k in range(12)) + "\nAll Rights Reserved.\nClick HERE now.", None, None),
        (12, "\n".join(f"He{k} said{k} so{k}!! Did{k} he{k}?? Why{k}!!" for k in range(20)), None, None), (4, "\n".join([GOOD] * 5), None, None),
        (None, "“Quite so.”\nIs it?)\nwhat… \nnot this", None, None), (13, " ".join(f"v{k % 30000}" for k in range(70_000)) + ".", None, None)]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 1000 else len(lines) - len(set(lines))
    base = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    lost = sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x in lines if removed(x))
    chars = sum(map(len, words))
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), base, not base and 100 * lost <= 50 * chars


def removed(line):
    n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
    bars = sum(line.count(s) for s in Q.SEPARATORS)
    low = re.sub("[A-Z]", lambda m: m.group().lower(), line)
    return (re.search(r"[.!?:;…。！？][\"')\]»”’]*[\x20\x09-\x0D]*\Z", line) is None
            or 5 * len(re.findall(r"[#*$%&|<>]", line)) > n or 5 * len(re.findall(r"[!?]{2,}", line)) > n
            or (n > 1 and len(re.findall("[A-Z]", line)) > len(re.findall("[a-z]", line)))
            or bars > 1 or any(p in low for p in Q.MENU + Q.NOTICE))


def test_equals_brute_force(spark):
    got = Q.clean_lines(spark.createDataFrame(ROWS, SCHEMA)).collect()
    pick = [(g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed, g.kept) for g in got]
    assert sorted(pick, key=str) == sorted([(r[0], *brute(r[1])) for r in ROWS], key=str)
    verdict = {g.doc_id: (g.base_failed, g.kept) for g in got}
    assert verdict[5] == verdict[11] == (False, True)
    assert verdict[6] == verdict[7] == verdict[8] == verdict[12] == (False, False)


def test_lines_go_and_text_stays(spark):
    got = {g.doc_id: g.cleaned for g in Q.clean_lines(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    text = dict((r[0], r[1]) for r in ROWS)
    for i, t in text.items():
        want = "\n".join(x for x in (t or "").split("\n") if not re.search(r"[^\x20\x09-\x0D]", x) or not removed(x))
        assert got[i] == want
    assert "Reserved" not in got[11] and "HERE" not in got[11]


def test_empty_table_and_names(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = Q.clean_lines(df.limit(0), with_text=False)
    assert out.columns == ["doc_id", *Q.MEASURES, "base_failed", "kept"] and out.count() == 0


def test_whole_table(spark):
    """The query keeps good documents of the small table and drops marked junk."""
    sf = "/root/testdata/sf0.01"
    got = Q.op13_line_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) == 0 and n[(1, True)] >= 50 * n.get((1, False), 0) and n[(0, False)] > 20


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_short_texts_have_no_repeats(n):
    assert Q.repeated_words([b"a"] * n) == 0
    assert Q.repeated_words([b"a"] * 4) == 4
