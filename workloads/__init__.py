"""The library's jobs on the test tables, each with the SQL that must give the same rows."""

from workloads import (
    associations, cleaning, distributions, encoding, models, profiling, sources, survey, windows,
)
from workloads.registry import all_queries, all_sql

__all__ = [
    "all_queries", "all_sql", "associations", "cleaning", "distributions", "encoding", "models", "profiling",
    "sources", "survey", "windows",
]
