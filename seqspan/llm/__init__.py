"""Training-data operators: ten corpus-scale jobs, independent of the timeline library."""
