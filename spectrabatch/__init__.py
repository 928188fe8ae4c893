"""Spark-native analytics for batch-process and spectroscopy tables.

Every operator is a function from DataFrame to DataFrame (or to a Column), so
a job is one lazy plan that Catalyst optimises as a whole.
"""

__version__ = "0.1.0"
