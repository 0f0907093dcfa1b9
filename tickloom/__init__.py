"""Market-microstructure analytics as Spark DataFrame functions."""
