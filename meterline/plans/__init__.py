"""Named queries and their SQL twins."""

from meterline.plans import projections, rollups, lists, flows  # noqa: F401
from meterline.plans.base import ORACLES, QUERIES  # noqa: F401
