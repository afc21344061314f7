"""Survey-index and catch analytics as Spark DataFrame transformations."""
