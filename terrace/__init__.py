"""Land-cover analytics expressed as Spark DataFrame queries."""
