"""Network-flow anomaly analytics as Spark DataFrame operators."""
