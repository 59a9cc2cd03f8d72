"""lodestone: an analytical SQL and data-processing engine written for PySpark."""

__version__ = "0.1.0"
