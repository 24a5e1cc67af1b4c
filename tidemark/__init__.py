"""Spark-native analytics over multi-stream append and release logs."""
