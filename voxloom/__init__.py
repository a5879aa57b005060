"""A Spark-native engine for data work on collections of labelled scans, and for training-data tables."""
