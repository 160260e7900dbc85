"""Queries over the star schema and the inputs of batch scoring."""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from lapforge import constants as K
from lapforge.functions.timing import avg_speed, format_lap_time, lap_progress, signed_delta
from lapforge.operators.shape import require, top_per_key, where_given
from lapforge.session import freeze, lookup

PAGE_ORDER = ["session_key", "driver_number", "lap_number"]


def _limit(n: int, top: int) -> int:
    if not 1 <= n <= top:
        raise ValueError(f"limit must be between 1 and {top}")
    return n


def list_circuits(circuits: DataFrame) -> DataFrame:
    return circuits.select(*K.CIRCUIT_COLS).orderBy("circuit_short_name", "circuit_key")


def get_circuit(circuits: DataFrame, circuit_key: int) -> DataFrame:
    return circuits.select(*K.CIRCUIT_COLS).where(F.col("circuit_key") == circuit_key).limit(1)


def list_drivers(drivers: DataFrame) -> DataFrame:
    return drivers.select(*K.DRIVER_COLS).orderBy("full_name", "driver_number")


def get_driver(drivers: DataFrame, driver_number: int) -> DataFrame:
    return drivers.select(*K.DRIVER_COLS).where(F.col("driver_number") == driver_number).limit(1)


def list_sessions(sessions: DataFrame, year=None, circuit_key=None, limit: int = 100) -> DataFrame:
    """Newest first."""
    return sessions.where(where_given(year=year, circuit_key=circuit_key)).select(*K.SESSION_COLS) \
        .orderBy(F.col("date_start").desc_nulls_first(), "session_key").limit(_limit(limit, K.MAX_SESSION_LIMIT))


@dataclass
class Page:
    """One page of laps. The total is counted when it is asked for."""
    data: DataFrame
    found: DataFrame
    page: int
    page_size: int

    @cached_property
    def total(self) -> int:
        return self.found.count()

    @property
    def total_pages(self) -> int:
        return -(-self.total // self.page_size)


def content_order(df: DataFrame, first: list[str]) -> list[str]:
    """first, then all other columns: a total order up to equal rows."""
    return first + [c for c in df.columns if c not in first]


def filter_laps(facts: DataFrame, year=None, circuit_key=None, driver_number=None, session_key=None) -> DataFrame:
    return facts.where(where_given(year=year, circuit_key=circuit_key, driver_number=driver_number,
                                   session_key=session_key)).select(*K.LAP_PAGE_COLS)


def laps_page(facts: DataFrame, page: int = 1, page_size: int = 100, **filters) -> Page:
    """Page by number. Each task keeps offset + page_size rows, so prefer laps_after far from the start."""
    if page < 1:
        raise ValueError("page starts at 1")
    size = _limit(page_size, K.MAX_PAGE_SIZE)
    found = filter_laps(facts, **filters)
    data = found.orderBy(*content_order(found, PAGE_ORDER)).offset((page - 1) * size).limit(size)
    return Page(data, found, page, size)


def page_info(facts: DataFrame, page: int = 1, page_size: int = 100, **filters) -> DataFrame:
    """Total, page, page size and page count as one row."""
    total = F.count(F.lit(1))
    return filter_laps(facts, **filters).agg(total.alias("total")).select(
        "total", F.lit(page).cast("long").alias("page"), F.lit(page_size).cast("long").alias("page_size"),
        F.ceil(F.col("total") / page_size).alias("total_pages"))


def laps_after(facts: DataFrame, last: tuple[int, int, int] | None, page_size: int = 100, **filters) -> DataFrame:
    """Next page after the (session, driver, lap) of the last row seen; its cost does not grow with depth."""
    found = filter_laps(facts, **filters)
    if last is not None:
        s, d, n = (F.lit(int(v)) for v in last)
        sk, dn, ln = (F.col(c) for c in PAGE_ORDER)
        found = found.where((sk > s) | ((sk == s) & ((dn > d) | ((dn == d) & (ln > n)))))
    return found.orderBy(*content_order(found, PAGE_ORDER)).limit(_limit(page_size, K.MAX_PAGE_SIZE))


def driver_laps(facts: DataFrame, driver_number: int, year=None, limit: int = 100) -> DataFrame:
    """Latest session first, laps in order."""
    found = filter_laps(facts, year=year, driver_number=driver_number)
    order = [F.col("session_key").desc(), *content_order(found, ["lap_number", "session_key"])]
    return found.orderBy(*order).limit(_limit(limit, K.MAX_LAP_LIMIT))


def circuit_laps(facts: DataFrame, circuit_key: int, year=None, limit: int = 100) -> DataFrame:
    """Fastest first."""
    found = filter_laps(facts, year=year, circuit_key=circuit_key)
    return found.orderBy(*content_order(found, [K.TARGET])).limit(_limit(limit, K.MAX_LAP_LIMIT))


def dataset_stats(facts: DataFrame, circuits: DataFrame, drivers: DataFrame, sessions: DataFrame) -> DataFrame:
    """Row counts, distinct years and the session date range, as one row."""
    def count(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    dates = sessions.agg(F.struct(F.min("date_start").alias("min"), F.max("date_start").alias("max"))).scalar()
    return facts.agg(F.count(F.lit(1)).alias("total_laps"), F.array_sort(F.collect_set("year")).alias("years")).select(
        "total_laps", count(circuits).alias("total_circuits"), count(drivers).alias("total_drivers"),
        count(sessions).alias("total_sessions"), "years", dates.alias("date_range"))


def circuit_averages(facts: DataFrame) -> DataFrame:
    return facts.groupBy("circuit_key").agg(F.avg(F.col(K.TARGET).cast("double")).alias("circuit_avg"))


def circuit_average_display(facts: DataFrame) -> DataFrame:
    """Mean lap per circuit, rounded and as m:ss.mmm."""
    return display_averages(circuit_averages(facts))


def display_averages(averages: DataFrame) -> DataFrame:
    return averages.where("circuit_avg IS NOT NULL").select(
        "circuit_key", F.round("circuit_avg", 3).alias("avg_laptime_seconds"),
        format_lap_time("circuit_avg").alias("avg_laptime_formatted"))


def driver_circuit_averages(facts: DataFrame) -> DataFrame:
    return facts.groupBy("driver_number", "circuit_key").agg(
        F.avg(F.col(K.TARGET).cast("double")).alias("driver_circuit_avg"))


def typical_max_laps(facts: DataFrame, rounded: bool = True) -> DataFrame:
    """Mean over sessions of the highest lap number, per circuit; serving rounds it, training does not."""
    per_session = facts.groupBy("circuit_key", "session_key").agg(F.max("lap_number").alias("max_lap"))
    mean = F.avg("max_lap")
    return per_session.groupBy("circuit_key").agg(
        (F.round(mean).cast("int") if rounded else mean).alias("typical_max_lap"))


def performance_scores(facts: DataFrame) -> DataFrame:
    """Driver mean minus circuit mean for every pair with laps, from one aggregation of the laps."""
    pairs = facts.groupBy("driver_number", "circuit_key").agg(
        F.sum(F.col(K.TARGET).cast("double")).alias("total"), F.count(K.TARGET).alias("n"))
    circuits = pairs.groupBy("circuit_key").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("circuit_avg"))
    return pairs.join(circuits, "circuit_key").select(
        "driver_number", "circuit_key",
        F.coalesce(F.col("total") / F.nullif("n", F.lit(0)) - F.col("circuit_avg"), F.lit(0.0)).alias("driver_perf_score"))


@dataclass(frozen=True)
class ServingTables:
    """Small lookup tables for scoring; built once per load of the facts."""
    circuits: DataFrame
    pairs: DataFrame


def serving_tables(facts: DataFrame) -> ServingTables:
    """One pass over the laps to (circuit, session, driver) partial sums; the two lookups come from that."""
    base = freeze(facts.groupBy("circuit_key", "session_key", "driver_number").agg(
        F.sum(F.col(K.TARGET).cast("double")).alias("total"), F.count(K.TARGET).alias("n"),
        F.max("lap_number").alias("max_lap")))
    return serving_tables_from(base)


def serving_tables_from(base: DataFrame) -> ServingTables:
    """The lookups from (circuit_key, session_key, driver_number, total, n, max_lap)."""
    mean = F.sum("total") / F.nullif(F.sum("n"), F.lit(0))
    per_session = base.groupBy("circuit_key", "session_key").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("max_lap").alias("max_lap"))
    circuits = per_session.groupBy("circuit_key").agg(
        mean.alias("_circuit_avg"), F.round(F.avg("max_lap")).cast("int").alias("_max_lap"))
    pairs = base.groupBy("driver_number", "circuit_key").agg(mean.alias("_pair_avg"))
    return ServingTables(lookup(circuits), lookup(pairs))


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); rejected rows carry the list of reasons."""
    needed = [c for c in K.REQUEST_BOUNDS if c not in K.REQUEST_OPTIONAL]
    require(requests, needed)
    reasons = []
    for c, (low, high) in K.REQUEST_BOUNDS.items():
        if c not in requests.columns:
            continue
        value = F.col(c)
        if c in needed:
            reasons.append(F.when(value.isNull(), f"{c} missing"))
        reasons.append(F.when(value < low, f"{c} < {low}"))
        if high is not None:
            reasons.append(F.when((value > high) | F.isnan(value.cast("double")), f"{c} > {high}"))
    checked = requests.withColumn("reason", F.array_compact(F.array(*reasons)))
    return checked.where(F.size("reason") == 0).drop("reason"), checked.where(F.size("reason") > 0)


def with_simple_defaults(requests: DataFrame) -> DataFrame:
    """Weather and lap number of the short request form."""
    given = {"temp": K.DEFAULT_TEMP, "rhum": K.DEFAULT_RHUM, "pres": K.DEFAULT_PRES, "lap_number": K.DEFAULT_LAP_NUMBER}
    for c, v in given.items():
        requests = requests.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in requests.columns else F.lit(v))
    return requests


def enrich_requests(requests: DataFrame, tables: ServingTables) -> DataFrame:
    """All model features for each request: given values win, then the lookups, then defaults."""
    def given(c: str) -> Column:
        return F.col(c) if c in requests.columns else F.lit(None)

    joined = requests.join(tables.circuits, "circuit_key", "left").join(
        tables.pairs, ["driver_number", "circuit_key"], "left")
    pair = F.coalesce("_pair_avg", "_circuit_avg")
    max_lap = F.nullif("_max_lap", F.lit(0))
    extra = {
        "year": F.coalesce(given("year"), F.lit(K.DEFAULT_YEAR)),
        "circuit_avg_laptime": F.coalesce(given("circuit_avg_laptime"), F.col("_circuit_avg"), F.lit(K.DEFAULT_CIRCUIT_AVG)),
        "driver_perf_score": F.coalesce(given("driver_perf_score"), pair - F.col("_circuit_avg"), F.lit(0.0)),
        "avg_speed": avg_speed(),
        "lap_progress": lap_progress("lap_number", max_lap, K.DEFAULT_MAX_LAP),
    }
    for name, value in extra.items():
        joined = joined.withColumn(name, value)
    return joined.drop("_circuit_avg", "_max_lap", "_pair_avg")


def driver_profiles(facts: DataFrame, laps: int = K.PROFILE_LAPS) -> DataFrame:
    """Means over each driver's latest laps, with defaults for what is missing. Only `laps` rows per
    driver and task reach the shuffle."""
    cols = list(K.DEFAULT_PROFILE)
    order = [F.col("session_key").desc(), *content_order(facts.select(*K.LAP_PAGE_COLS), ["lap_number", "session_key"])]
    latest = top_per_key(facts.select(*K.LAP_PAGE_COLS), ["driver_number"], order, laps)
    names = {K.TARGET: "avg_laptime", **{c: f"avg_{c}" for c in cols if c != K.TARGET}}
    return latest.groupBy("driver_number").agg(*[
        F.coalesce(F.avg(F.col(c).cast("double")), F.lit(K.DEFAULT_PROFILE[c])).alias(names[c]) for c in cols])


def compare_predictions(scored: DataFrame, tables: ServingTables, profiles: DataFrame,
                        prediction: str = "prediction") -> DataFrame:
    """Prediction against the circuit's and the driver's average."""
    joined = scored.join(tables.circuits.select("circuit_key", "_circuit_avg"), "circuit_key", "left").join(
        profiles.select("driver_number", F.col("avg_laptime").alias("_driver_avg")), "driver_number", "left")
    circuit = F.coalesce("_circuit_avg", F.lit(K.DEFAULT_CIRCUIT_AVG))
    driver = F.coalesce("_driver_avg", F.lit(K.DEFAULT_PROFILE[K.TARGET]))
    return joined.withColumn("delta_circuit", F.col(prediction) - circuit).withColumn(
        "delta_driver", F.col(prediction) - driver).withColumn(
        "delta_circuit_text", signed_delta(prediction, circuit)).withColumn(
        "delta_driver_text", signed_delta(prediction, driver)).withColumn(
        "prediction_text", format_lap_time(prediction)).drop("_circuit_avg", "_driver_avg")
