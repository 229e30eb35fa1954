"""Subject-erasure analytics for chunk-deduplicated backups, on Spark DataFrames."""
