"""Event cross-section analytics on trade ticks, expressed as Spark DataFrame operators."""

__version__ = "0.1.0"
