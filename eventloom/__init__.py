"""Event-stream, trajectory and raster analytics as PySpark DataFrame functions."""
