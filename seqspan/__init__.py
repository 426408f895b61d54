"""Timeline analytics on Spark: frame indexes, interval algebra, runs, break detection, learning, jobs and watching."""
