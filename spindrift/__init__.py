"""Spark-native crawl and URL analytics."""
