"""Time-series signal analytics on Spark: table-to-table operators over bars, signals and texts."""
