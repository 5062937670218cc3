"""Two-stage content recommendation on Spark: recall, features and ranking."""
