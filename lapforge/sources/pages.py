"""Circuit tables and coordinates from a table of raw pages (page_id, url, html)."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lapforge.functions.html import read_page
from lapforge.session import store

_OUT = ("page_id long, url string, row int, circuit_name string, circuit_url string, "
        "locality string, country string, latitude double, longitude double")
_COLS = [c.split()[0] for c in _OUT.split(", ")]


def read_pages(pages: DataFrame, base_url: str) -> DataFrame:
    """One row per circuit listed on a page, plus one row (row = -1) with the page's coordinates."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, url, html in batch.itertuples(index=False):
                rows, lat, lon = read_page(html, base_url)
                out += [(page_id, url, i, r["circuit_name"], r["circuit_url"], r["locality"], r["country"], None, None)
                        for i, r in enumerate(rows)]
                if lat is not None:
                    out.append((page_id, url, -1, None, None, None, None, lat, lon))
            yield pd.DataFrame(out, columns=_COLS).astype({"latitude": "float64", "longitude": "float64"})

    return pages.select("page_id", "url", "html").mapInPandas(parse, _OUT)


def page_circuits(pages: DataFrame, base_url: str, scraped_at: str | None = None) -> DataFrame:
    """Listed circuits with the coordinates found on each circuit's own page. Pages are parsed once: the few parsed rows are stored."""
    parsed = store(read_pages(pages, base_url))
    listed = parsed.where("row >= 0").select("circuit_name", "circuit_url", "locality", "country")
    spots = parsed.where("row = -1").groupBy(F.col("url").alias("circuit_url")).agg(
        F.min(F.struct("page_id", "latitude", "longitude")).alias("spot"))
    stamp = F.lit(scraped_at) if scraped_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return listed.join(spots, "circuit_url", "left").select(
        "circuit_name", "circuit_url", "locality", "country", F.col("spot.latitude").alias("latitude"),
        F.col("spot.longitude").alias("longitude"), stamp.alias("scraped_at_utc"))
