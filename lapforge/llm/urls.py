"""URL filter with a history: list entries hold for a time, and each capture meets those that held when it was fetched.

An entry is (pattern, verdict, listed_at); verdict is block, allow or lift (lift ends what held before). A pattern is
    domain:<host>          the host and all hosts below it
    path:<host>/<a>[/<b>[/<c>]]  that host, and paths whose first one to three segments are these
    url:<host><path?query>  that one address
The most specific pattern that holds decides: url before path before domain, longer before shorter.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lapforge.llm.common import free_name

SEGMENTS = 3
EVENTS_PER_SLOT = 64


def host_of(url: Column) -> Column:
    """Lower-cased host, without user, port and final dot; empty if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """Host, path and query; the fragment is not part of an address."""
    return F.concat(host_of(url), F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^#]*)", 1))


def keys_of(url: Column) -> Column:
    """All patterns that an address can meet, as (pattern, rank): at most its host labels + SEGMENTS + 1."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, n - i + 1), ".")).alias("pattern"),
        (n - i + 1).cast("int").alias("rank")))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    deep = F.least(F.size(segments), F.lit(SEGMENTS))
    counts = F.when(deep > 0, F.sequence(F.lit(1), F.greatest(deep, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    paths = F.transform(counts, lambda i: F.struct(
        F.concat(F.lit("path:"), host_of(url), F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")).alias("pattern"),
        (F.lit(1000) + i).cast("int").alias("rank")))
    whole = F.array(F.struct(F.concat(F.lit("url:"), address_of(url)).alias("pattern"), F.lit(2000).alias("rank")))
    return F.when(host_of(url) != "", F.concat(domains, paths, whole))


def validity(entries: DataFrame, slot_events: int = EVENTS_PER_SLOT) -> tuple[DataFrame, DataFrame]:
    """(slots, pieces) of dated entries (pattern, verdict, listed_at as timestamp).

    The time line of each pattern is cut into equal slots, as many as it has slot_events events; a piece is a validity
    interval clipped to its slot. A slot without an event of its own gets the state that was carried into it, so a
    pattern with very many events is worked on in many small windows, and never meets captures event by event.
    Entries with a null in any of the three columns are left out. Of entries of one pattern and moment, block comes
    before allow before lift.
    """
    strength = F.when(F.col("verdict") == "block", 2).when(F.col("verdict") == "allow", 1).otherwise(0)
    events = entries.select("pattern", "verdict", F.unix_micros("listed_at").alias("at")).dropna()
    events = events.groupBy("pattern", "at").agg(F.max_by("verdict", strength).alias("verdict"))
    slots = events.groupBy("pattern").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n"))
    slots = slots.select("pattern", "first_at", F.ceil(F.col("n") / slot_events).alias("slots"),
                         (F.floor((F.col("last_at") - F.col("first_at")) / F.ceil(F.col("n") / slot_events)) + 1).alias("width"))
    placed = events.join(slots, "pattern").withColumn("slot", slot_at())
    ends = F.lead("at").over(W.partitionBy("pattern", "slot").orderBy("at"))
    inner = placed.select("pattern", "slot", F.col("at").alias("since"), ends.alias("until"), "verdict", F.col("at").alias("listed"))
    # What each slot leaves behind holds in the slots after it, up to and including the next one with events.
    left = placed.groupBy("pattern", "slot").agg(F.max_by("verdict", "at").alias("verdict"), F.max("at").alias("listed"),
                                                 F.min("at").alias("opens"), F.first("slots").alias("slots"))
    later = W.partitionBy("pattern").orderBy("slot")
    left = left.withColumn("next_slot", F.lead("slot").over(later)).withColumn("next_opens", F.lead("opens").over(later))
    last = F.coalesce("next_slot", F.col("slots") - 1)
    carried = left.where(last > F.col("slot")).select(
        "pattern", F.explode(F.sequence(F.col("slot") + 1, last)).alias("slot"), "verdict", "listed", "next_slot", "next_opens")
    carried = carried.select("pattern", "slot", F.lit(None).cast("long").alias("since"),
                             F.when(F.col("slot") == F.col("next_slot"), F.col("next_opens")).alias("until"), "verdict", "listed")
    return slots, inner.unionByName(carried)


def slot_at(at: str = "at") -> Column:
    """Slot of a moment; the last slot has no end."""
    return F.least(F.floor((F.col(at) - F.col("first_at")) / F.col("width")), F.col("slots") - 1)


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at",
                slot_events: int = EVENTS_PER_SLOT) -> DataFrame:
    """captures with `blocked`, `matched` (the pattern that decided, null if none) and `listed_at` (since when it held).

    Only (address, moment) pairs are judged, each once, so repeated captures of one address meet before any join.
    Null url or time, or a url without host: not blocked, no match. Empty captures: no rows; empty entries: nothing is
    blocked. Columns called blocked, matched or listed_at are replaced; all others are kept.
    """
    captures = captures.drop("blocked", "matched", "listed_at")
    u, t = free_name(captures, "judged_url"), free_name(captures, "judged_at")
    moments = captures.select(F.col(url).alias(u), F.unix_micros(fetched_at).alias("at")).dropna().distinct()
    asked = moments.select(u, "at", F.explode(keys_of(F.col(u))).alias("key")).select(u, "at", "key.pattern", "key.rank")
    slots, pieces = validity(entries, slot_events)
    asked = asked.join(slots, "pattern").where(F.col("at") >= F.col("first_at")).withColumn("slot", slot_at())
    holds = (F.coalesce(asked["at"] >= F.col("since"), F.lit(True))) & (F.coalesce(asked["at"] < F.col("until"), F.lit(True)))
    met = asked.join(pieces, ["pattern", "slot"]).where(holds & (F.col("verdict") != "lift"))
    best = met.groupBy(u, F.col("at").alias(t)).agg(F.max_by(F.struct("verdict", "pattern", "listed"), "rank").alias("hit"))
    joined = captures.join(best, (captures[url] == best[u]) & (F.unix_micros(captures[fetched_at]) == best[t]), "left")
    return joined.select(*(captures[c] for c in captures.columns), F.coalesce(F.col("hit.verdict") == "block", F.lit(False)).alias("blocked"),
                         F.col("hit.pattern").alias("matched"), F.timestamp_micros("hit.listed").alias("listed_at"))
