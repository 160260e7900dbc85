"""The run and drift jobs over landed files."""

import json

import pytest

from lapforge import constants as K, schemas
from lapforge.job import main
from lapforge.operators import models


def test_run_job(spark, tmp_path):
    land, out = tmp_path / "landing", str(tmp_path / "out")
    for name in ("sessions", "laps", "drivers", "circuit_urls", "circuit_stations", "weather/007__land__town"):
        (land / name).mkdir(parents=True)
    sessions = [{"year": y, "meeting_key": 100 + y, "session_key": y, "session_name": "Race", "session_type": "Race", "circuit_key": 5,
                 "date_start": f"{y}-03-02T15:00:00+00:00", "date_end": f"{y}-03-02T17:00:00+00:00", "gmt_offset": "03:00:00",
                 "circuit_short_name": "Ring", "location": "Town", "country_name": "Land", "country_code": "LND", "country_key": 1} for y in (2023, 2024)]
    (land / "sessions" / "a.json").write_text(json.dumps(sessions))
    (land / "drivers" / "a.json").write_text(json.dumps([{"driver_number": d, "full_name": f"D{d}", "session_key": 2023} for d in (1, 2)]))
    names = schemas.LAP_RECORDS.fieldNames()
    for y in (2023, 2024):
        lines = [",".join(names)]
        for d in (1, 2):
            for lap in range(1, 16):
                v = {"meeting_key": 100 + y, "session_key": y, "driver_number": d, "lap_number": lap, "lap_duration": 90 + lap / 10 + d,
                     "date_start": f"{y}-03-02 15:{lap:02}:00", "st_speed": 300 + lap, "i1_speed": 290, "i2_speed": 280 if lap % 2 else ""}
                lines.append(",".join(str(v.get(n, "")) for n in names))
        (land / "laps" / f"laps_session_{y}.csv").write_text("\n".join(lines) + "\n")
        (land / "weather/007__land__town" / f"{y}.csv").write_text(
            ",".join(schemas.WEATHER_RECORDS.fieldNames()) + f"\n{y},3,2,15,21.5,40,1010,,,,\n")
    (land / "circuit_urls" / "a.csv").write_text("circuit_key,wikipedia_circuit_url\n5,https://x.org/wiki/Ring\n")
    (land / "circuit_stations" / "a.csv").write_text("circuit_url,station_id\nhttps://x.org/wiki/Ring,007\n")
    code = main(["run", "--landing", str(land), "--out", out, "--years", "2023", "2024"], spark)
    assert code == 0
    facts = spark.read.parquet(f"{out}/star/fact_laps")
    # 30 laps a session; the quantile bounds cut the fastest and the slowest.
    assert facts.count() == 56 and facts.where("temp = 21.5 AND year = 2024").count() == 28
    assert facts.where("source_file = 'laps_session_2024.csv'").count() == 28
    assert json.loads(spark.read.text(f"{out}/manifest_clean").first()[0])["n_ok"] == 2
    assert main(["run", "--landing", str(land), "--out", out, "--verify-only"], spark) == 0
    assert main(["drift", "--out", out, "--since", "2024-01-01 00:00:00"], spark) == 0
    drifted = {r["feature"]: r["statistic"] for r in spark.read.parquet(f"{out}/drift").collect()}
    assert drifted["year"] == 1.0 and drifted["st_speed"] < 0.2


PAGE = """<table class="wikitable"><tbody><tr><th>Circuit</th><th>Map</th><th>Type</th><th>Dir</th><th>Location</th><th>Country</th></tr>
<tr><td><a href="/wiki/Ring">Ring</a></td><td></td><td></td><td></td><td><a href="/t">Town</a></td><td><a href="/l">Land</a></td></tr></tbody></table>"""


def test_score_job_uses_the_model_of_the_best_run(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(1000 + s, s, d, lap, 2023 + s % 2, d % 3, 90.0 + lap / 10 + d, 290.0, 280.0, 270.0, 20.0 + d, 40.0, 1000.0) for s in (1, 2) for d in range(1, 6) for lap in range(1, 30)]
    facts = spark.createDataFrame(rows, "meeting_key long, session_key long, driver_number long, lap_number long, year long, circuit_key long, lap_duration double, "
                                        "st_speed double, i1_speed double, i2_speed double, temp double, rhum double, pres double")
    for c in set(K.LAP_PAGE_COLS) | set(K.MODEL_FEATURES):
        if c not in facts.columns:
            facts = facts.selectExpr("*", f"CAST(30 AS DOUBLE) AS {c}")
    facts.write.parquet(f"{out}/star/fact_laps")
    paths = {}
    for name, depth in (("good", 6), ("bad", 1)):
        paths[name] = f"{out}/models/{name}"
        models.save(models.fit(facts, "random_forest", numTrees=3, maxDepth=depth), paths[name])
    spark.createDataFrame([("good", "random_forest", 2.0, 0.5, 0.9, paths["good"]), ("bad", "random_forest", 3.0, 4.0, 0.1, paths["bad"])],
                          "run_id string, model_family string, overfitting_ratio double, test_mae double, test_r2 double, model_path string").write.parquet(f"{out}/runs")
    base = {"circuit_key": 1, "driver_number": 1, "lap_number": 5, "st_speed": 300.0, "i1_speed": 290.0, "i2_speed": 280.0, "temp": 21.0, "rhum": 40.0, "pres": 1000.0}
    base |= {c: 30.0 for c in K.REQUEST_BOUNDS if c not in base and c not in K.REQUEST_OPTIONAL}
    (tmp_path / "requests.json").write_text("\n".join(json.dumps(r) for r in (base, base | {"temp": 900.0})))
    assert main(["score", "--out", out, "--requests", str(tmp_path / "requests.json")], spark) == 0
    got = spark.read.parquet(f"{out}/predictions").collect()
    want = models.load(paths["good"]).transform(spark.read.parquet(f"{out}/predictions").drop("prediction", "features")).first()["prediction"]
    assert len(got) == 1 and got[0]["prediction"] == pytest.approx(want)
    assert spark.read.parquet(f"{out}/rejected_requests").count() == 1


def test_match_job_writes_what_run_reads(spark, tmp_path):
    land, out = tmp_path / "landing", str(tmp_path / "out")
    for name in ("sessions", "weather/007__land__town"):
        (land / name).mkdir(parents=True)
    session = {"year": 2024, "meeting_key": 1, "session_key": 2, "session_name": "Race", "session_type": "Race", "circuit_key": 5, "date_start": "2024-03-02T15:00:00+00:00",
               "date_end": "2024-03-02T17:00:00+00:00", "gmt_offset": "03:00:00", "circuit_short_name": "Ring", "location": "Town", "country_name": "Land", "country_code": "LND", "country_key": 1}
    (land / "sessions" / "a.json").write_text(json.dumps([session]))
    (land / "weather/007__land__town" / "2024.csv").write_text(",".join(schemas.WEATHER_RECORDS.fieldNames()) + "\n2024,3,2,15,21.5,40,1010,,,,\n")
    spark.createDataFrame([(1, "https://x.org/list", PAGE), (2, "https://x.org/wiki/Ring", '<span class="geo">10.5; 20.5</span>')],
                          "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "stations.csv").write_text(",".join(schemas.STATIONS.fieldNames()) + "\n" + ",".join(
        {"id": "007", "country": "LD", "latitude": "10.6", "longitude": "20.6", "elevation": "5"}.get(c, "") for c in schemas.STATIONS.fieldNames()) + "\n")
    (tmp_path / "names.csv").write_text(",".join(schemas.STATION_NAMES.fieldNames()) + "\n" + ",".join(
        {"station": "007", "name": "Field", "language": "en"}.get(c, "") for c in schemas.STATION_NAMES.fieldNames()) + "\n")
    assert main(["match", "--landing", str(land), "--out", out, "--pages", str(tmp_path / "pages"), "--base-url", "https://x.org", "--years", "2024",
                 "--stations", str(tmp_path / "stations.csv"), "--station-names", str(tmp_path / "names.csv")], spark) == 0
    urls = spark.read.option("header", True).csv(f"{land}/circuit_urls").collect()
    near = spark.read.option("header", True).csv(f"{land}/circuit_stations").collect()
    assert [tuple(r) for r in urls] == [("5", "https://x.org/wiki/Ring")] and [tuple(r) for r in near] == [("https://x.org/wiki/Ring", "007")]
