"""Every operator as a query over the test tables, with its SQL twin."""

from gridspark.queries import (aggregate, balance, calendar, cleaning, filling, flows, joining, masking, quality,
                               rollout, sampling, samples, scoring, series, skill, sources, space, streams)
from gridspark.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
