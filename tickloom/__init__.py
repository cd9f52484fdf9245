"""Market and retail price jobs on Spark."""
