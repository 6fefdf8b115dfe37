"""gridshift: memory-bounded re-chunking of N-dimensional arrays, as Spark shuffles."""

from .api import Rechunked, rechunk
from .plans.planner import ExcessiveIOWarning, multistage_rechunking_plan, rechunking_plan

__all__ = ["ExcessiveIOWarning", "Rechunked", "multistage_rechunking_plan", "rechunk", "rechunking_plan"]
