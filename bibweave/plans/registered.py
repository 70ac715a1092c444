"""All registered queries of the reference's operators: QUERIES and ORACLES."""

from bibweave.plans import curated, printed, records  # noqa: F401
from bibweave.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
