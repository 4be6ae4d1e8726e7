"""Every registered query with its oracle. Importing this package fills the registry."""

from replicalens.catalog import (  # noqa: F401
    aggregates,
    filters,
    joins,
    plans,
    scalars,
    sources,
    streams,
)
from replicalens.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
