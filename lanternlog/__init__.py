"""Spark-native analytics over ordered activity logs, export snapshots and documents."""
