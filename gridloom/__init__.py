"""Gridloom: rasters, detections and corpora as Spark DataFrames."""

__version__ = "0.1.0"
