"""Spark-native analytics over trajectories, evidence text and evaluation results."""
