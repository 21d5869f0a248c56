"""commstream: incremental community detection and corpus operators on PySpark DataFrames."""
