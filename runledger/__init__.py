"""Spark-native analytics for runs, checkpoints, stored objects, heartbeats, metrics and logs."""
