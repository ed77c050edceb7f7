"""Registered queries over the test tables, each with its SQL twin where SQL can express it."""

from wavetable.queries.registry import QUERIES, SQL
from wavetable.queries import (  # noqa: F401  (importing registers)
    aggregates,
    cleaning,
    learning,
    ranking,
    scalars,
    sources,
    spectra,
)

__all__ = ["QUERIES", "SQL"]
