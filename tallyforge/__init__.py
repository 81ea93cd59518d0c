"""tallyforge: a PySpark-native engine for catalogue-monitoring data."""
