"""Registered queries over the driver tables, with the SQL that states them."""

from . import graphs, judgement, measures, scalars, shapes, spatial  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
