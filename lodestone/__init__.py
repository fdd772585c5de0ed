"""Spark-native retrieval, ranking and text-processing engine.

Operators are plain functions from DataFrames to DataFrames; nothing here keeps
a global session. See README.md for the map of modules.
"""

__version__ = "0.1.0"
