"""prefengine: a PySpark-native engine that curates conversational training data."""
