"""Spark-native preparation, scoring and comparison of transcribed and translated text."""
