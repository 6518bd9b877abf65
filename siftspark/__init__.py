"""A PySpark-native engine for community discussion data and corpora made from it."""
