"""Spark-native analytics over sparse gridded observations."""
