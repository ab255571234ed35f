"""All registered queries. Importing a section module registers its ids."""

from respondo.catalog import (decisions, io, modelling, preparation,  # noqa: F401
                              profiling, segments)
from respondo.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
