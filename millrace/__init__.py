"""A PySpark-native analytics engine: typed tables with constraints and snapshots, queries, plans and statistics."""
