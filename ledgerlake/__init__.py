"""PySpark-native analytics over monthly, revisioned research data."""
