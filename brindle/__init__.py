"""Spark-first analytics over relational state, pixel rasters, region graphs and job events."""
