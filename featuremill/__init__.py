"""Feature-by-sample analytics as plain ``DataFrame -> DataFrame`` functions on Spark."""
