"""Trip-fare analytics as lazy Spark DataFrame operators."""
