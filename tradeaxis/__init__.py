"""End-of-day market data, completeness, datasets, rankings and portfolio plans on Spark."""

__version__ = "0.1.0"
