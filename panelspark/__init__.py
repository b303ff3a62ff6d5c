"""panelspark: retail household-panel analytics as Spark DataFrame jobs."""

from panelspark.config import Thresholds
from panelspark.plans.warehouse import Warehouse

__all__ = ["Thresholds", "Warehouse"]
