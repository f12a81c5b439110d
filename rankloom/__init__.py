"""rankloom: cross-sectional factor ranking and training-data operators as Spark DataFrame programs."""

__version__ = "0.1.0"
