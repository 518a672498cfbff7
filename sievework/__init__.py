"""A Spark-native engine that curates, audits and orders language-model training data."""
