"""Machine-health analytics on recorded signals, as Spark DataFrame transformations."""
