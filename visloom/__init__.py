"""Prepare and measure image-text datasets with Spark DataFrames."""

__version__ = "0.1.0"
