"""Document intelligence and operational analytics expressed as Spark jobs."""

__version__ = "0.1.0"
