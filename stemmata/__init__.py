"""Spark-native comparison of categorical typing profiles and inference of directed trees."""
