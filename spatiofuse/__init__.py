"""Spark-native analytics for daily spatio-temporal sensor panels."""
