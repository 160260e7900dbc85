"""End-to-end plans: landed tables to dataset, star schema and checks."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lapforge.operators.clean import CleanRules, clean_report, kept_laps, label_laps
from lapforge.operators.context import add_context, context_report
from lapforge.operators.dataset import build_dataset, dataset_columns, quality_summary
from lapforge.operators.quality import pipeline_checks
from lapforge.operators.scope import build_scope, latest_drivers
from lapforge.operators.star import constraint_violations, load_star, table_counts
from lapforge.operators.weather import (attach_weather, circuit_stations, failed_sessions, strict_sessions,
                                        weather_report, with_weather_only)
from lapforge.session import store
from lapforge.sources.sinks import report_table


@dataclass(frozen=True)
class Inputs:
    sessions: DataFrame
    laps: DataFrame
    drivers: DataFrame
    circuit_urls: DataFrame
    url_stations: DataFrame
    weather: DataFrame


@dataclass(frozen=True)
class Result:
    scope: DataFrame
    dataset: DataFrame
    summary: DataFrame
    reports: dict[str, DataFrame]

    def star(self, inputs: Inputs) -> dict[str, DataFrame]:
        return load_star(self.dataset, self.scope, latest_drivers(inputs.drivers))

    def checks(self, tables: dict[str, DataFrame]) -> DataFrame:
        return pipeline_checks(self.summary, table_counts(tables))


def run(inputs: Inputs, years=None, session_type: str = "Race", rules: CleanRules = CleanRules(),
        strict: bool = False, frozen: bool = False) -> Result:
    """One lazy graph from laps to dataset; nothing but the per-session bounds is computed here.

    strict drops whole sessions that miss a station or a weather year; otherwise their laps
    simply find no weather. With frozen=True the joined laps are written once, for callers that
    use the dataset, its summary and the star schema together.
    """
    scope = build_scope(inputs.sessions, years, session_type)
    labelled = label_laps(inputs.laps, rules)
    enriched = add_context(kept_laps(labelled), scope)
    mapping = circuit_stations(inputs.circuit_urls, inputs.url_stations)
    joined = attach_weather(enriched, mapping, inputs.weather)
    failed = failed_sessions(enriched, mapping, inputs.weather)
    if strict:
        joined = strict_sessions(joined, failed)
    located = with_weather_only(joined)
    if frozen:
        located = store(dataset_columns(located))
    reports = {"clean": report_table(clean_report(labelled)), "context": report_table(context_report(enriched)),
               "weather": report_table(weather_report(joined), failed)}
    return Result(scope, build_dataset(located), quality_summary(located), reports)


def verify(tables: dict[str, DataFrame]) -> DataFrame:
    return constraint_violations(tables)
