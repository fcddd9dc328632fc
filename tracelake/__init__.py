"""Spark-native analytics over application-server event logs."""
