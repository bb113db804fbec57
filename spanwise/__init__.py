"""Service-telemetry analytics as Spark DataFrame operators."""
