"""PySpark-native analytics over cross-referencing documents and their evaluation."""
