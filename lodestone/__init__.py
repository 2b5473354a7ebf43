"""Spark-native analytics over mixed C-and-SQL code bases, and over any tables shaped like them."""
