"""Invoice matching and payment control as Spark DataFrame transformations."""
