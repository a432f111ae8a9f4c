"""Every operator as a query on the given tables, with its definition in SQL."""

from wearline.plans.catalogue import (  # noqa: F401  (each module registers its queries)
    contracts,
    costs,
    drift,
    features,
    governance,
    learned,
    lifetimes,
    serving,
    streams,
)
from wearline.plans.catalogue import ranges  # noqa: F401  (repeats definitions of the others)
from wearline.plans.catalogue.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
