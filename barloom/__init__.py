"""Market-intelligence operators as Spark DataFrame transformations."""
