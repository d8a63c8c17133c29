"""Spark-native flood-depth scenario engine over gridded terrain tables."""
