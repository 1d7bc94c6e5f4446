"""quern: a PySpark-native analytics engine for process mining and general OLAP."""
