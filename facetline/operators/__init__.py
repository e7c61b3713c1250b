"""Operators on DataFrames: search, ranking, statistics, models and raster kernels."""
