"""Import order of the query modules."""

from lapforge.plans import catalog_pipeline, catalog_serve  # noqa: F401
from lapforge.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
