"""Registered queries over the given tables, and the SQL they are checked against."""

from sensorframe.plans import core, loading, runlogs, variants
from sensorframe.plans.oracles import ORACLES

QUERIES = {**core.QUERIES, **variants.QUERIES, **loading.QUERIES, **runlogs.QUERIES}

__all__ = ["ORACLES", "QUERIES"]
