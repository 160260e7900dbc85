"""Names, matching and stations."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lapforge.constants import MATCH_WEIGHTS
from lapforge.functions import geo, text
from lapforge.operators import match, stations


def column(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(expr("v")).collect()]


def test_norm_text(spark):
    given = ["  São   Paulo! ", "Montréal-Québec", None, "!!", "Straße ½", "A\tB\nC"]
    assert column(spark, given, text.norm_text) == ["sao paulo", "montreal quebec", "", "", "strae 12", "a b c"]


def test_slug(spark):
    assert column(spark, ["São Paulo", "--a--b--", "", None, "x" * 50], lambda c: text.slug(c, 10)) == [
        "sao-paulo", "a-b", "unknown", "unknown", "x" * 10]


def test_ratio_matches_the_published_algorithm(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 30))) for _ in range(120)] + ["ab" * 150, "ba" * 140]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(400)] + [("ab" * 150, "ba" * 140), (None, "a")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(text.ratio("a", "b")).collect()]
    want = [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]
    assert got == want and all(0 <= x <= 1 for x in got)


def test_page_id(spark):
    urls = ["https://en.x.org/wiki/N%C3%BCrburgring", "https://x.org/wiki/a+b%20c?q=1#f", "https://x.org/other", None, "https://x.org/wiki/a/wiki/b"]
    assert column(spark, urls, text.page_id) == ["Nürburgring", "a+b c", None, None, "a/wiki/b"]


def test_encoded_name():
    assert [text.encoded_name(c) for c in ("circuit_key", "driver_number", "year")] == [
        "circuit_avg_laptime", "driver_avg_laptime", "year_avg_laptime"]


def test_haversine(spark):
    row = spark.range(1).select(geo.haversine_km(F.lit(48.8566), F.lit(2.3522), F.lit(51.5074), F.lit(-0.1278)).alias("d")).first()
    assert row["d"] == pytest.approx(343.56, abs=0.05)


LEFT = "circuit_key long, circuit_short_name string, country_name string, location string"
RIGHT = "circuit_name string, country string, locality string, circuit_url string, latitude double, longitude double"


def brute_force(left, right, top_n):
    from lapforge.functions.text import _ascii
    import re
    norm = lambda s: re.sub(r"[^a-z0-9]+", " ", _ascii((s or "").strip().lower())).strip()
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    out = {}
    for key, short, country, loc in left:
        same = [p for p in right if norm(p[1]) == norm(country)] or right
        scored = []
        for p in same:
            names = {"short": norm(short), "loc": norm(loc), "name": norm(p[0]), "locality": norm(p[2])}
            scored.append((-sum(w * ratio(names[a], names[b]) for a, b, w in MATCH_WEIGHTS), p[3]))
        out[key] = [(url, round(-s, 4)) for s, url in sorted(scored)[:top_n]]
    return out


def test_candidates_against_brute_force(spark):
    rng = random.Random(11)
    syllables = ["mon", "za", "spa", "sil", "ver", "stone", "São", "Pa", "ulo", "dé"]
    name = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    left = [(i, name(), rng.choice(["Italy", "BRAZIL", "Mónaco", "Atlantis"]), rng.choice([name(), "", None])) for i in range(12)]
    right = [(name() + " Circuit", rng.choice(["Italy", "Brazil", "Monaco"]), name(), f"https://x.org/wiki/{i:03}", 1.0, 2.0) for i in range(40)]
    got = match.match_candidates(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), 4).collect()
    want = brute_force(left, right, 4)
    for key, expected in want.items():
        mine = sorted((r for r in got if r["circuit_key"] == key), key=lambda r: r["candidate_rank"])
        assert [(r["wikipedia_circuit_url"], r["match_score"]) for r in mine] == [(u, pytest.approx(s, abs=1e-4)) for u, s in expected]


def candidates(spark):
    cols = ["circuit_key", "candidate_rank", "match_score", "wikipedia_circuit_url", "wikipedia_latitude", "wikipedia_longitude"]
    rows = [(1, 1, 0.9, "a", "1.0", "2.0"), (1, 2, 0.8, "b", "x", "2.0"), (2, 1, 0.7, "c", "1", "2")]
    return spark.createDataFrame(rows, "circuit_key long, candidate_rank int, match_score double, wikipedia_circuit_url string, wikipedia_latitude string, wikipedia_longitude string").select(*cols)


def overrides(spark, rows):
    return spark.createDataFrame(rows, "circuit_key long, chosen_candidate_rank int")


def test_overrides(spark):
    picked = lambda ov: {r["circuit_key"]: r["wikipedia_circuit_url"] for r in match.final_mapping(candidates(spark), ov).collect()}
    assert picked(None) == {1: "a", 2: "c"}
    assert picked(overrides(spark, [(1, 2)])) == {1: "b", 2: "c"}
    with pytest.raises(match.MappingError):
        match.final_mapping(candidates(spark), overrides(spark, [(2, 3)]))
    chosen = match.final_mapping(candidates(spark), overrides(spark, [(1, 2)]))
    assert [r["circuit_key"] for r in match.without_coordinates(chosen).collect()] == [1]
    with pytest.raises(match.MappingError):
        match.final_mapping(candidates(spark), overrides(spark, [(1, 2)]), fail_on_missing_latlon=True)


def station_parts(spark):
    circuits = spark.createDataFrame([("u1", "Ring One", "L1", "C1", 10.0, 10.0), ("u2", "Ring Two", "L2", "C2", 50.0, 50.0),
                                      ("u3", "Far", "L3", "C3", -60.0, 0.0), ("u4", "Edge", "L4", "C4", 0.0, 179.0)],
                                     "circuit_url string, circuit_name string, locality string, country string, latitude double, longitude double")
    st = spark.createDataFrame([("001", "X", 10.0, 10.5, 1.0), ("002", "X", 14.9, 10.0, 1.0), ("003", "X", 15.1, 10.0, 1.0), ("004", "X", 58.0, 50.0, 1.0),
                                ("005", "X", 62.0, 50.0, 1.0), ("006", "X", 0.0, -179.0, 1.0)],
                               "id string, country string, latitude double, longitude double, elevation double")
    return circuits, st


def test_nearest_stations(spark):
    got = {}
    for r in stations.nearest_stations(*station_parts(spark)).collect():
        got.setdefault(r["circuit_url"], []).append((r["station_rank"], r["id"]))
    # u2 finds nothing within 5 degrees and takes what lies within 15; u3 and u4 (no wrap) find nothing.
    assert {k: sorted(v) for k, v in got.items()} == {"u1": [(1, "001"), (2, "002")], "u2": [(1, "004"), (2, "005")]}


def test_station_choice(spark):
    circuits, st = station_parts(spark)
    names = spark.createDataFrame([("001", "Eins", "de"), ("001", "One", "en"), ("002", "Zwei", "de"), ("004", None, "en")], "station string, name string, language string")
    have = spark.createDataFrame([("001", 2023), ("002", 2023), ("002", 2024), ("005", 2023)], "station_id string, year int")
    cand = stations.station_candidates(circuits, st, names, have, [2023, 2024])
    chosen = {r["circuit_url"]: r for r in stations.choose_stations(cand).collect()}
    assert (chosen["u1"]["station_id"], chosen["u1"]["selection_rule"], chosen["u1"]["coverage_notes"]) == ("002", "nearest_with_full_coverage", "")
    assert (chosen["u2"]["station_id"], chosen["u2"]["coverage_notes"]) == ("005", "missing_years=2024")
    assert chosen["u1"]["circuit_id"] == "ring-one" and chosen["u1"]["station_name"] == "Zwei"
    named = {r["station_id"]: r["station_name"] for r in stations.station_names(names).collect()}
    assert named == {"001": "One", "002": "Zwei", "004": None}
    folders = {r["station_id"]: r["folder"] for r in stations.station_folders(stations.choose_stations(cand)).collect()}
    assert folders == {"002": "002__c1__l1", "005": "005__c2__l2"}


def test_only_texts_with_marks_reach_python(spark):
    """Folding equals the plain way on odd texts, and ASCII ones are folded in place."""
    from lapforge.functions import text as folding
    odd = ["\x1f a\x85 B\x1c", "\xa0xÉ ", "  ABC\n", "", "ﬁn", "\x00A", None, "İI", "A ", " \x0b\x0c\x1d", "Straße-Ñ 9"]
    df = spark.createDataFrame([(v,) for v in odd], "v string").select("v", folding.fold_ascii(F.col("v")).alias("folded"))
    assert [r["folded"] for r in df.collect()] == [None if v is None else folding._ascii(v.strip().lower()) for v in odd]
    sent = df._jdf.queryExecution().optimizedPlan().toString().split("fold_marked(")[1]
    assert sent.startswith("CASE WHEN RLIKE(") or "RLIKE" in sent.split(")#")[0]
