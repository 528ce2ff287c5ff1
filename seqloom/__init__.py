"""Spark-native engine for collections of highly similar sequences."""
