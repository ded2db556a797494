"""File-access analytics on Spark: logs in, chunk-size recommendations out."""
