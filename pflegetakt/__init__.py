"""Hospital nursing-workload and staffing analytics on Spark DataFrames."""

from pflegetakt.plans.staffing import Inputs, Staffing
from pflegetakt.settings import Settings

__all__ = ["Inputs", "Settings", "Staffing"]
