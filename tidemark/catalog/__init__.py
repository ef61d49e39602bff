"""Named queries, one per operator, with SQL equivalents."""

from tidemark.catalog.registry import ORACLES, QUERIES
from tidemark.catalog import (  # noqa: F401
    asof,
    factors,
    validation,
    universe,
    events,
    selection,
    scoring,
    portfolio,
    scalars,
    quality,
    extraction,
    runlog,
    reports,
    ingest,
)

__all__ = ["ORACLES", "QUERIES"]
