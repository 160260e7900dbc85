"""Purges: folders that go, months that are cut, rows that stay."""

import datetime as dt


from lapforge import session
from lapforge.job import main
from lapforge.sources import retention, sinks

NOW = "2025-01-15 12:00:00"
POLICY = {"log": 90, "a/b=c %": 30}


def rows(spark):
    days = [0, 29, 30, 31, 45, 46, 88, 89, 90, 91, 107, 108, 140, 400, 900]
    at = dt.datetime(2025, 1, 15, 11)
    data = [(c, i, at - dt.timedelta(days=d)) for c in ("log", "a/b=c %", "other") for i, d in enumerate(days)]
    data += [("log", 100, None), (None, 101, at), ("other", 102, None), ("log", 103, at + dt.timedelta(days=40))]
    return spark.createDataFrame(data, "category string, id int, ts timestamp")


def content(df):
    return sorted(map(repr, df.select("category", "id", "ts").collect()))


def test_a_purge_leaves_what_is_retained(spark, tmp_path):
    path, df = str(tmp_path / "t"), rows(spark)
    retention.write_by_month(df, path, "ts")
    before = retention.partitions(spark, path)
    done = {(r["category"], r["month"]): (r["action"], r["removed"]) for r in retention.purge(spark, path, df.schema, "ts", NOW, POLICY).collect()}
    left = retention.read_by_month(spark, path, df.schema)
    assert content(left) == content(sinks.retained(df, "category", "ts", NOW, POLICY))
    assert done["log", "2024-10"] == ("rewritten", 1) and done["log", "2024-09"] == ("dropped", None) and done["a/b=c %", "2024-12"] == ("rewritten", 2)  # 31 and 45 days
    after = retention.partitions(spark, path)
    assert set(before) - set(after) == {k for k, (action, _) in done.items() if action == "dropped"}
    assert retention.purge(spark, path, df.schema, "ts", NOW, POLICY).count() == 0
    assert content(left) == content(retention.read_by_month(spark, path, df.schema))


def test_untouched_months_keep_their_files(spark, tmp_path):
    path, df = str(tmp_path / "t"), rows(spark)
    retention.write_by_month(df, path, "ts")
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    done = {(r["category"], r["month"]) for r in retention.purge(spark, path, df.schema, "ts", NOW, POLICY).collect()}
    touched = {p for p in set(before) ^ set(files())}
    assert touched and all("category=other" not in p for p in touched)
    same = {k for k in retention.partitions(spark, path) if k not in done}
    assert ("log", "2025-01") in same and ("log", "2024-11") in same and files().items() >= {(p, t) for p, t in before.items() if p not in touched}


def test_a_month_at_the_limit_without_rows_to_keep_is_dropped(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("log", 1, dt.datetime(2024, 10, 1)), ("log", 2, dt.datetime(2025, 1, 1))], "category string, id int, ts timestamp")
    retention.write_by_month(df, path, "ts")
    assert [tuple(r) for r in retention.purge(spark, path, df.schema, "ts", NOW, POLICY).collect()] == [("log", "2024-10", "dropped", 1)]
    assert [r["id"] for r in retention.read_by_month(spark, path, df.schema).collect()] == [2]
    assert retention.purge(spark, path, df.schema, "ts", NOW, {}).count() == 0


def test_purge_job(spark, tmp_path):
    path, out = str(tmp_path / "t"), str(tmp_path / "out")
    df = rows(spark)
    retention.write_by_month(df, path, "ts")
    assert main(["purge", "--table", path, "--now", NOW, "--out", out], spark) == 0
    assert content(retention.read_by_month(spark, path, df.schema)) == content(sinks.retained(df, "category", "ts", NOW))
    assert spark.read.parquet(f"{out}/purged").where("category = 'log'").count() >= 3


def test_folders_are_deleted(spark, tmp_path):
    df = spark.range(3)
    df.write.parquet(str(tmp_path / "x"))
    session.delete_folder(spark, str(tmp_path / "x"))
    session.delete_folder(spark, str(tmp_path / "never there"))
    assert not (tmp_path / "x").exists()
