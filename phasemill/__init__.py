"""Periodic-imaging analytics over lakes of recordings, as PySpark DataFrame operators."""

__version__ = "0.1.0"
