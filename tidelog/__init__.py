"""tidelog: a PySpark-native analytics engine for event logs."""
