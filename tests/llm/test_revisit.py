import random

import pytest
from pyspark.sql import functions as F

from fieldlens.llm import revisit as W

SCHEMA = "record_id long, kind string, url string, ts long, headers map<string,string>, range string, target_id string"
ALLOWED = {"cache-control", "content-location", "date", "etag", "expires", "vary"}


def canonical(url):
    if url is None:
        return None
    from urllib.parse import urlsplit

    url = url.strip(" ").split("#")[0]
    parts = urlsplit(url)
    if not parts.scheme or "://" not in url:
        return url
    host, rest = parts.netloc.lower(), url.split("://", 1)[1][len(parts.netloc):]
    for scheme, port in (("http", ":80"), ("https", ":443")):
        if parts.scheme.lower() == scheme and host.endswith(port):
            host = host[:-len(port)]
    return f"{parts.scheme.lower()}://{host}{rest if rest.startswith('/') else '/' + rest}"


def brute(rows):
    out = []
    for rid, kind, url, ts, headers, *_ in rows:
        if kind != "revisit":
            continue
        headers = headers or {}
        near = [(r[3], r[0], r[4] or {}) for r in rows if r[1] == "response" and None not in (r[2], r[3], url, ts)
                and canonical(r[2]) == canonical(url) and r[3] < ts]
        best = max(near, key=lambda x: x[:2]) if near else None
        tag, since = headers.get("etag"), headers.get("last-modified")
        if best is None:
            status = "orphan"
        elif tag is None and since is None:
            status = "unchecked"
        else:
            status = "resolved" if (best[2].get("etag") == tag if tag is not None else best[2].get("last-modified") == since) else "changed"
        merged = {**best[2], **{k: v for k, v in headers.items() if k in ALLOWED}} if status == "resolved" else None
        out.append((rid, canonical(url), best and best[1], best and best[0], status, merged))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_equals_brute_force(spark, ranges):
    r = random.Random(13)
    urls = ["http://Hot.example/a", "HTTP://hot.example:80/a#x", "https://b.example:443", "https://b.example/", "http://c.example?q=1", "http://c.example/?q=1",
            "not a url", None]
    rows = []
    for i in range(400):
        kind = r.choice(["response", "revisit"])
        headers = {k: r.choice(["1", "2"]) for k in ("etag", "last-modified", "date", "server", "vary") if r.random() < 0.5}
        rows.append((i, kind, r.choice(urls[:2] * 3 + urls), r.choice([None] + list(range(60)) * 2), headers if r.random() < 0.95 else None, "x", "y"))
    rows.append(rows[next(i for i, x in enumerate(rows) if x[1] == "revisit")])
    got = W.resolve_revisits(spark.createDataFrame(rows, SCHEMA), ranges).collect()
    assert sorted([tuple(g) for g in got], key=str) == brute(rows)


def test_a_repeated_response_counts_once(spark):
    rows = [(1, "response", "http://a.example/", 1, {"etag": "t"}, None, None)] * 2 + [(2, "revisit", "http://a.example/", 5, {"etag": "t"}, None, None)]
    assert W.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).count() == 1


def test_empty(spark):
    assert W.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_derived_records(spark):
    pages = spark.createDataFrame([(i, f"http://a.example/{i % 5}", f"<p>{i}</p>") for i in range(30)] + [(33, None, None)], "page_id long, url string, html string")
    records = W.records_of_pages(pages)
    assert records.where(F.col("kind") == "response").count() == 31 and records.where(F.col("kind") == "revisit").count() == 11
    assert {r.status for r in W.resolve_revisits(records).collect()} >= {"changed", "orphan"}


def test_a_url_that_holds_most_captures_is_cut_by_counts(spark):
    """One record at time 0, the others at the end of the time axis: ranges still share the URL."""
    rows = [(0, "response", "http://hot.example/", 0, {"etag": "0"}, None, None)]
    rows += [(i, "response" if i % 10 == 0 else "revisit", "http://hot.example/", 10 ** 12 + i, {"etag": str(i // 10)}, None, None) for i in range(1, 3000)]
    got = {r.record_id: (r.target_id, r.status) for r in W.resolve_revisits(spark.createDataFrame(rows, SCHEMA), 16).collect()}
    assert got == {i: (i // 10 * 10, "resolved") for i in range(1, 3000) if i % 10}
    times = spark.createDataFrame(rows, SCHEMA).repartitionByRange(16, "url", "ts").groupBy(F.spark_partition_id()).count().collect()
    assert len(times) == 16 and max(t["count"] for t in times) < 600


def test_different_responses_of_one_id_give_one_result(spark):
    rows = [(1, "response", "http://a.example/", 1, {"etag": t}, None, None) for t in "tuv"] + [(2, "revisit", "http://a.example/", 5, {"etag": "t"}, None, None)]
    first = W.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    again = W.resolve_revisits(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert len(first) == 1 and first == again
