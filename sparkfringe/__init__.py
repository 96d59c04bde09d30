"""Spark-native calibration and analytics of interferometer visibilities."""
