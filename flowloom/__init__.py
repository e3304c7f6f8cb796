"""Spark-native network-flow behaviour analytics."""
