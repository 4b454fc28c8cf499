"""Spark-native lattice analytics: typed operators over DataFrames."""
