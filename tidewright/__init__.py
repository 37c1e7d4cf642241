"""Spark-native reasoning-quality and recommendation analytics engine."""
