"""Dated list entries against captures, compared with a loop over all entries."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lapforge.llm import urls

DAY = datetime(2024, 3, 1)


def brute(captures, entries):
    """For each capture the newest entry at its time per pattern, then the most specific pattern."""
    out = []
    for url, at in captures:
        best = None
        if url and at and "://" in url:
            host = url.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
            rest = url.split("://", 1)[1].partition("/")
            tail = (rest[1] + rest[2]).split("#")[0]
            path = [s for s in tail.split("?")[0].split("/") if s]
            labels = host.split(".")
            keys = {f"domain:{'.'.join(labels[i:])}": len(labels) - i for i in range(len(labels))} if host else {}
            keys |= {f"path:{host}/{'/'.join(path[:i])}": 1000 + i for i in range(1, min(3, len(path)) + 1)} if host else {}
            keys |= {f"url:{host}{tail}": 2000} if host else {}
            for pattern, rank in keys.items():
                held = [(t, {"block": 2, "allow": 1, "lift": 0}[v], v) for p, v, t in entries if p == pattern and v and t and t <= at]
                if held and max(held)[2] != "lift" and (best is None or rank > best[0]):
                    best = (rank, max(held)[2] == "block", pattern, max(held)[0])
        out.append((url, at, best[1] if best else False, best[2] if best else None, best[3] if best else None))
    return out


ENTRIES = ([("domain:bad.org", "block", DAY), ("domain:bad.org", "lift", DAY + timedelta(days=5)), ("domain:bad.org", "block", DAY + timedelta(days=9)),
            ("path:ok.bad.org/a/b", "allow", DAY + timedelta(days=1)), ("url:ok.bad.org/a/b/c?x=1", "block", DAY + timedelta(days=2)),
            ("domain:same.org", "block", DAY), ("domain:same.org", "allow", DAY), (None, "block", DAY), ("domain:nul.org", None, DAY), ("domain:nul.org", "block", None)]
           + [("domain:busy.org", ("block", "allow", "lift")[k % 3], DAY + timedelta(minutes=7 * (k % 150))) for k in range(400)])
CAPTURES = ([("http://bad.org/", DAY + timedelta(days=d)) for d in range(-1, 12)]
            + [("https://user@OK.bad.org.:8080/a/b/c?x=1#top", DAY + timedelta(days=d)) for d in (0, 1, 2, 3)]
            + [("https://ok.bad.org/a/b", DAY + timedelta(days=6)), ("https://ok.bad.org/a/bc", DAY + timedelta(days=6)), ("http://same.org", DAY), (None, DAY),
               ("http://bad.org/", None), ("", DAY), ("no address", DAY), ("http:///x", DAY), ("http://nul.org/", DAY + timedelta(days=3))]
            + [("http://busy.org/x", DAY + timedelta(minutes=k)) for k in range(-3, 1100, 11)] + [("http://bad.org/", DAY)] * 3)


@pytest.mark.parametrize("events", [1, 3, 64])
def test_like_a_loop_over_entries(spark, events):
    captures = spark.createDataFrame(CAPTURES, "url string, fetched_at timestamp").withColumn("matched", F.lit("old")).withColumn("slot", F.lit(1))
    entries = spark.createDataFrame(ENTRIES, "pattern string, verdict string, listed_at timestamp")
    got = urls.filter_urls(captures, entries, slot_events=events)
    assert got.columns == ["url", "fetched_at", "slot", "blocked", "matched", "listed_at"]
    rows = [tuple(r) for r in got.select("url", "fetched_at", "blocked", "matched", "listed_at").collect()]
    assert sorted(rows, key=repr) == sorted(brute(CAPTURES, ENTRIES), key=repr)


def test_empty_tables(spark):
    captures = spark.createDataFrame(CAPTURES, "url string, fetched_at timestamp")
    entries = spark.createDataFrame(ENTRIES, "pattern string, verdict string, listed_at timestamp")
    assert urls.filter_urls(captures.limit(0), entries).count() == 0
    assert not urls.filter_urls(captures, entries.limit(0)).where("blocked OR matched IS NOT NULL").count()


def test_no_python_in_the_plan(spark):
    captures = spark.createDataFrame(CAPTURES, "url string, fetched_at timestamp")
    entries = spark.createDataFrame(ENTRIES, "pattern string, verdict string, listed_at timestamp")
    plan = urls.filter_urls(captures, entries)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
