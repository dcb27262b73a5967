"""Case-report analytics written as Spark DataFrame transformations."""
