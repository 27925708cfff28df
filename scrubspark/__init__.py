"""scrubspark: table cleaning, profiling and analysis as Spark jobs.

Every stage takes and returns DataFrames. Decisions that depend on the data
(which text column becomes a date, which median fills a column) come from a
small number of aggregate jobs whose results are O(columns); the tables
themselves never pass through the driver.
"""

from scrubspark.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
