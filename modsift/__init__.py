"""Spark-native text moderation analytics: collect, clean, featurise, audit, evaluate."""
