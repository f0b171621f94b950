"""A PySpark-native engine for product evidence: harvest, distil, draft, classify, serve, score."""
