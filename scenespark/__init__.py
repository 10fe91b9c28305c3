"""scenespark: georeferenced-scene analytics as Spark DataFrame transformations."""
