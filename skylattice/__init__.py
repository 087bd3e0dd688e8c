"""Spark-native airline schedule and itinerary analytics."""
