"""Queries on the star schema as it is stored.

Facts lie in folders by year, and inside a year in order of circuit, session, driver and lap, so a year prunes folders and
a circuit prunes row groups. Beside them lies `lap_totals`: one row per (year, circuit, session, driver) with the number,
the sum and the highest number of its laps. It tells in which years, circuits and sessions a page, a driver's latest laps
or a session are, so that a lookup without a year still reads only a few row groups; counts and means need no laps at all.
"""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lapforge import constants as K, schemas
from lapforge.operators import serve
from lapforge.operators.ordered import HOT_ROWS, hot_groups, prefix_sums
from lapforge.operators.shape import where_given
from lapforge.session import lookup
from lapforge.sources.sinks import write_star

TOTALS = "lap_totals"
PLACE = ["year", "circuit_key", "session_key", "driver_number"]
# Distinct years or circuits that a lookup names one by one; with more of them it names their range.
NAMED = 100


def lap_totals(facts: DataFrame) -> DataFrame:
    """Laps are decimals, so their sums are exact and means from them do not depend on an order."""
    return facts.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("laps"), F.sum(K.TARGET).alias("total"), F.max("lap_number").alias("max_lap"))


def write(tables: Mapping[str, DataFrame], folder: str, mode: str = "overwrite", placed: bool = False) -> None:
    """The tables of the star, and the totals of what is then stored (also after an append)."""
    write_star(tables, folder, mode, placed)
    spark = tables["fact_laps"].sparkSession
    totals = lap_totals(StoredStar(spark, folder).facts)
    totals.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).write.mode("overwrite").parquet(f"{folder}/{TOTALS}")


@dataclass(frozen=True)
class StoredStar:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        """A table with its declared columns and types, whatever the folder names look like."""
        schema = schemas.STAR[name]
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").select(*schema.fieldNames())

    @cached_property
    def facts(self) -> DataFrame:
        return self.table("fact_laps")

    @cached_property
    def totals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{TOTALS}")

    circuits = cached_property(lambda self: self.table("dim_circuits"))
    drivers = cached_property(lambda self: self.table("dim_drivers"))
    sessions = cached_property(lambda self: self.table("dim_sessions"))

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in schemas.STAR}


def _among(column: str, values: Sequence) -> Column:
    """A condition that folders and row groups can be told by: the values, or their range if there are many."""
    known = sorted(set(values))
    return F.col(column).isin(known) if len(known) <= NAMED else F.col(column).between(known[0], known[-1])


def _narrowed(star: StoredStar, found: list, **filters) -> DataFrame:
    """Facts of the places found (rows of totals), besides the filters themselves."""
    facts = star.facts.where(where_given(**filters))
    for c in PLACE[:3]:
        values = [r[c] for r in found]
        if values and None not in values:
            facts = facts.where(_among(c, values))
    return facts.select(*K.LAP_PAGE_COLS)


def filter_laps(star: StoredStar, year=None, circuit_key=None, driver_number=None, session_key=None) -> DataFrame:
    """Laps by the given values. A session names its year and circuit, so its laps are read from there alone."""
    given = dict(year=year, circuit_key=circuit_key, driver_number=driver_number, session_key=session_key)
    if session_key is None:
        return serve.filter_laps(star.facts, **given)
    where = star.totals.where(where_given(**given)).select(*PLACE[:3]).distinct().limit(NAMED + 1).collect()
    return _narrowed(star, where if len(where) <= NAMED else [], **given)


def circuit_laps(star: StoredStar, circuit_key: int, year=None, limit: int = 100) -> DataFrame:
    """Fastest first."""
    return serve.circuit_laps(star.facts, circuit_key, year, limit)


def _sessions(star: StoredStar, filters: Mapping, order: Column, n: int) -> list:
    """The first n sessions in the given order with their places and number of laps: at most n rows."""
    return star.totals.where(where_given(**filters)).groupBy(*PLACE[:3]).agg(F.sum("laps").alias("laps")).orderBy(order, *PLACE[:2]).limit(n).collect()


def _until(found: list, laps: int) -> list | None:
    """As many of the sessions as hold that many laps, with all rows of the last one; None if they do not."""
    held = 0
    for i, r in enumerate(found):
        if held >= laps and r["session_key"] != found[i - 1]["session_key"]:
            return found[:i]
        held += r["laps"]
    return found if held >= laps else None


def driver_laps(star: StoredStar, driver_number: int, year=None, limit: int = 100) -> DataFrame:
    """Latest session first, laps in order. Only the sessions that hold the driver's last laps are read."""
    filters = {"driver_number": driver_number, "year": year}
    # one more session than laps, so that the last one is known to be whole
    found = _until(_sessions(star, filters, F.col("session_key").desc(), limit + 1), limit)
    return serve.driver_laps(_narrowed(star, found or [], **filters), driver_number, year, limit)


def laps_after(star: StoredStar, last: tuple[int, int, int] | None, page_size: int = 100, **filters) -> DataFrame:
    """Next page after the (session, driver, lap) of the last row seen, from the sessions that hold it."""
    totals = star.totals.where(where_given(**filters))
    if last is not None:
        totals = totals.where(F.col("session_key") >= int(last[0]))
    per = totals.groupBy(*PLACE[:3]).agg(F.sum("laps").alias("laps")).orderBy(F.col("session_key"), *PLACE[:2]).limit(page_size + 2).collect()
    # how many laps of the last row's own session are over is not known, so they do not count
    own = [r for r in per if last is not None and r["session_key"] == last[0]]
    rest = _until(per[len(own):], page_size)
    facts = _narrowed(star, own + rest, **filters) if rest else serve.filter_laps(star.facts, **filters)
    return serve.laps_after(facts, last, page_size)


def laps_page(star: StoredStar, page: int = 1, page_size: int = 100, **filters) -> DataFrame:
    """A page by its number. The totals tell which sessions it lies in; only those are read, however far it is."""
    if page < 1 or not 1 <= page_size <= K.MAX_PAGE_SIZE:
        raise ValueError(f"page starts at 1, and holds 1 to {K.MAX_PAGE_SIZE} rows")
    first = (page - 1) * page_size
    per = star.totals.where(where_given(**filters)).groupBy("session_key").agg(
        F.sum("laps").alias("laps"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    sums = prefix_sums(per, [], ["session_key"], ["laps"], hot_groups(per, [], HOT_ROWS))
    before = F.col("laps_upto") - F.col("laps")
    hit = sums.where((F.col("laps_upto") > first) & (before < first + page_size)).agg(
        F.min("session_key").alias("low"), F.max("session_key").alias("high"), F.min(before).alias("before"), F.count_if(F.col("session_key").isNull()).alias("unnamed"),
        F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year")).first()
    if hit["before"] is None:
        return serve.filter_laps(star.facts, **filters).limit(0)
    if hit["unnamed"]:  # sessions without a key come first and are in no range
        return serve.laps_page(star.facts, page, page_size, **filters).data
    part = serve.filter_laps(star.facts.where(F.col("year").between(hit["first_year"], hit["last_year"])
                                              & F.col("session_key").between(hit["low"], hit["high"])), **filters)
    return part.orderBy(*serve.content_order(part, serve.PAGE_ORDER)).offset(first - hit["before"]).limit(page_size)


def page_info(star: StoredStar, page: int = 1, page_size: int = 100, **filters) -> DataFrame:
    total = F.coalesce(F.sum("laps"), F.lit(0)).cast("long")
    return star.totals.where(where_given(**filters)).agg(total.alias("total")).select(
        "total", F.lit(page).cast("long").alias("page"), F.lit(page_size).cast("long").alias("page_size"), F.ceil(F.col("total") / page_size).alias("total_pages"))


# ---- statistics from the totals -----------------------------------------------------------------

def mean_lap(totals: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return totals.groupBy(*keys).agg((F.sum("total").cast("double") / F.nullif(F.sum("laps"), F.lit(0))).alias(name))


def circuit_averages(star: StoredStar) -> DataFrame:
    return mean_lap(star.totals, ["circuit_key"], "circuit_avg")


def circuit_average_display(star: StoredStar) -> DataFrame:
    return serve.display_averages(circuit_averages(star))


def driver_circuit_averages(star: StoredStar) -> DataFrame:
    return mean_lap(star.totals, ["driver_number", "circuit_key"], "driver_circuit_avg")


def typical_max_laps(star: StoredStar, rounded: bool = True) -> DataFrame:
    return serve.typical_max_laps(star.totals.select("circuit_key", "session_key", F.col("max_lap").alias("lap_number")), rounded)


def performance_scores(star: StoredStar) -> DataFrame:
    """Driver mean minus circuit mean for every pair with laps."""
    pairs = driver_circuit_averages(star).join(lookup(circuit_averages(star)), "circuit_key")
    return pairs.select("driver_number", "circuit_key", F.coalesce(F.col("driver_circuit_avg") - F.col("circuit_avg"), F.lit(0.0)).alias("driver_perf_score"))


def serving_tables(star: StoredStar) -> serve.ServingTables:
    return serve.serving_tables_from(star.totals.select(
        "circuit_key", "session_key", "driver_number", F.col("total").cast("double").alias("total"), F.col("laps").alias("n"), "max_lap"))


def dataset_stats(star: StoredStar, sessions: DataFrame | None = None) -> DataFrame:
    """Row counts, distinct years and the session date range, as one row; sessions: other than the stored ones."""
    sessions = star.sessions if sessions is None else sessions
    dates = sessions.agg(F.struct(F.min("date_start").alias("min"), F.max("date_start").alias("max"))).scalar()

    def count(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    return star.totals.agg(F.coalesce(F.sum("laps"), F.lit(0)).cast("long").alias("total_laps"), F.array_sort(F.collect_set("year")).alias("years")).select(
        "total_laps", count(star.circuits).alias("total_circuits"), count(star.drivers).alias("total_drivers"),
        count(sessions).alias("total_sessions"), "years", dates.alias("date_range"))


def driver_profiles(star: StoredStar, laps: int = K.PROFILE_LAPS) -> DataFrame:
    """Means over each driver's latest laps. The totals name the sessions they are in, and those prune years and rows."""
    newest = Window.partitionBy("driver_number").orderBy(F.col("session_key").desc())
    per = star.totals.groupBy("driver_number", "session_key").agg(F.sum("laps").alias("laps"), F.collect_set("year").alias("year"))
    held = per.withColumn("newer", F.sum("laps").over(newest.rowsBetween(Window.unboundedPreceding, -1)))
    needed = held.where(F.coalesce("newer", F.lit(0)) < laps).select("driver_number", "session_key", F.explode("year").alias("year"))
    needed = lookup(needed).select(F.col("driver_number").alias("_d"), F.col("session_key").alias("_s"), F.col("year").alias("_y")).where("_y > 0")
    same = F.col("driver_number").eqNullSafe(F.col("_d")) & F.col("session_key").eqNullSafe(F.col("_s")) & (F.col("year") == F.col("_y"))
    return serve.driver_profiles(star.facts.join(needed, same, "left_semi"), laps)
