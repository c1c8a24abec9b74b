"""Run analytics on PySpark: telemetry, trajectories, sensor streams, similarity, graphs and pipeline health."""
