"""rivulet: channel comment-stream ingest and keyed state tables on Spark.

Every operator takes and returns DataFrames; nothing is collected to the driver.
"""

__version__ = "0.1.0"
