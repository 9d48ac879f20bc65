"""Operators for large training-data pipelines. Nothing outside this folder imports it, but for the guarded import in __spark_entry__."""
