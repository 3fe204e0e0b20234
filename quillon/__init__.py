"""Spark-native analytics for vectors, activations, graphs and the tables around them."""
