"""panelwright: Spark-native analytics for look-ahead-safe panel and event data."""
