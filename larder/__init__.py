"""Market food price analytics as Spark DataFrame operators."""
