"""Used-car valuation analytics expressed as Spark DataFrame, SQL, ML and streaming jobs."""

from motoquant.config import Rules

__all__ = ["Rules"]
